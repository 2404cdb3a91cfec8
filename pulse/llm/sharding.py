"""K-d tree sharding: recursive weighted-median splits along the widest metadata dimension.

Every document is a point: its metadata dimensions scaled to 0..1, its bytes as weight. A node that is to
become k shards is cut where floor(k / 2) / k of its bytes lie, along the dimension in which its points spread
widest, until every leaf is one shard near the target bytes. Points are ordered in a dimension by one integer:
the coordinate in ``COORD_BITS``, then bits of the text's hash (equal texts lie together),
then bits of the document's hash (a group heavier than the tolerance is cut through).

Medians are distributed: all nodes of a level are searched at once; bytes are summed by (node, one of
``BUCKETS`` equal ranges), running sums name the range that holds the cut, and it is divided further until it
weighs at most ``TOLERANCE`` of a shard. The driver holds the tree only: one cut per shard.

Cases: null text is 0 bytes; null dimensions are a value of their own, below all; identical rows are points of
their own (one hash: kept together); with fewer documents than shards some shards stay empty.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import cut, gapless, payload, unit_hash

COORD_BITS, TEXT_BITS, DOC_BITS = 20, 22, 20
KEY_BITS = COORD_BITS + TEXT_BITS + DOC_BITS
BUCKETS = 2048
TOLERANCE = 0.004


@dataclasses.dataclass
class Node:
    """Shards first .. first + shards - 1; once cut: points with key < at in dimension dim go left."""

    first: int
    shards: int
    dim: int = -1
    at: int = 0
    left: Node | None = None
    right: Node | None = None

    def place(self, value) -> Column:
        """The number that ``value(leaf)`` gives for the leaf a point falls into."""
        if self.left is None:
            return F.lit(value(self)).cast("int")
        return F.when(F.col(f"k{self.dim}") < self.at, self.left.place(value)).otherwise(self.right.place(value))

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else [*self.left.leaves(), *self.right.leaves()]


def _find_cuts(points: DataFrame, root: Node, dims: int, open_: dict[int, tuple[int, int]],
               allowed: float) -> None:
    """Set ``at`` of the open leaves (by first shard: dimension, bytes that go left)."""
    spark = points.sparkSession
    leaves = {x.first: x for x in root.leaves()}
    low, before = dict.fromkeys(open_, 0), dict.fromkeys(open_, 0)
    width = dict.fromkeys(open_, 1 << KEY_BITS)
    at = points.withColumn("node", root.place(lambda x: x.first))
    todo = set(open_)
    while todo:
        step = {k: max(1, width[k] // BUCKETS) for k in todo}
        # one row for each open node: at most as many as shards
        ranges = F.broadcast(spark.sql("SELECT * FROM VALUES " + ", ".join(
            f"({k}, {open_[k][0]}, {low[k]}L, {step[k]}L, {low[k] + width[k]}L, {open_[k][1] - before[k]}L)" for k in sorted(todo))
            + " AS t(node, dim, low, step, high, goal)"))
        key = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"k{i}")) for i in range(dims)])
        inside = (at.join(ranges, "node").withColumn("key", key)
                  .where((F.col("key") >= F.col("low")) & (F.col("key") < F.col("high"))))
        sums = inside.groupBy("node", "goal", F.expr("(key - low) div step").alias("bucket")).agg(
            F.sum("size").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most"))
        sums = sums.withColumn("until", F.sum("bytes").over(Window.partitionBy("node").orderBy("bucket")))
        hit = sums.where((F.col("until") >= F.col("goal")) & (F.col("until") - F.col("bytes") < F.col("goal")))
        found = {r["node"]: r for r in hit.collect()}  # a row for each node at most
        for k in sorted(todo):
            r = found.get(k)
            if r is None:  # nothing left to divide: all of it goes left
                leaves[k].at = low[k] + width[k]
                todo.discard(k)
                continue
            low[k], width[k] = r["least"], r["most"] - r["least"] + 1
            upto = before[k] + r["until"]
            before[k] = upto - r["bytes"]
            if r["bytes"] <= allowed or width[k] == 1:
                nearer_left = upto - open_[k][1] < open_[k][1] - before[k]
                leaves[k].at = low[k] + (width[k] if nearer_left else 0)
                todo.discard(k)


def grow_tree(points: DataFrame, dims: int, shards: int, tolerance: float = TOLERANCE) -> Node:
    """The K-d tree over ``points`` (size, c0.. coordinates, k0.. order keys)."""
    root = Node(0, shards)
    allowed = None
    while True:
        leaves = {x.first: x for x in root.leaves() if x.shards > 1}
        if not leaves:
            return root
        spread = [(F.max(f"c{i}") - F.min(f"c{i}")).alias(f"w{i}") for i in range(dims)]
        stats = {r["node"]: r for r in points.withColumn("node", root.place(lambda x: x.first)).groupBy("node")
                 .agg(F.sum("size").alias("bytes"), *spread).collect()}  # a row for each node
        if allowed is None:
            allowed = tolerance * (stats[0]["bytes"] if stats else 0) / shards
        open_ = {}
        for k, leaf in leaves.items():
            r = stats.get(k)
            leaf.dim = max(range(dims), key=lambda i: (r[f"w{i}"], -i)) if r else 0  # noqa: B023
            if r:
                open_[k] = (leaf.dim, round(r["bytes"] * (leaf.shards // 2) / leaf.shards))
        if open_:
            _find_cuts(points, root, dims, open_, allowed)
        for leaf in leaves.values():
            half = leaf.shards // 2
            leaf.left, leaf.right = Node(leaf.first, half), Node(leaf.first + half, leaf.shards - half)


def kd_shards(docs: DataFrame, size: Column, dims: dict[str, Column], text: Column, key: list[Column], shards: int = 40,
              tolerance: float = TOLERANCE, seed: int = 29) -> DataFrame:
    """``row`` (all columns of docs), ``size``, ``shard``, ``slot`` (gapless in the shard).

    ``dims`` are numeric expressions; ``key`` tells documents apart.
    """
    names = [f"v{i}" for i in range(len(dims))]
    rows = cut(docs.select(
        payload(docs), size.alias("size"), *[v.cast("double").alias(n) for n, v in zip(names, dims.values(), strict=True)],
        unit_hash(text, seed=seed).alias("t"), unit_hash(*key, seed=seed).alias("d")))
    ends = rows.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()
    cells = (1 << COORD_BITS) - 1
    cols = []
    for i, n in enumerate(names):
        lo, hi = ends[f"lo_{n}"], ends[f"hi_{n}"]
        wide = (hi - lo) if lo is not None and hi > lo else 1.0
        coord = F.coalesce((F.col(n) - F.lit(lo or 0.0)) / F.lit(wide) * 0.999 + 0.001, F.lit(0.0))
        cell = F.floor(coord * cells).cast("long")
        order = F.shiftleft(cell, TEXT_BITS + DOC_BITS) + F.shiftleft(F.shiftright("t", 63 - TEXT_BITS), DOC_BITS) + F.shiftright("d", 63 - DOC_BITS)
        cols += [coord.alias(f"c{i}"), order.alias(f"k{i}")]
    points = rows.select("row", "size", "d", "t", *cols)
    root = grow_tree(points, len(dims), shards, tolerance)
    placed = points.select("row", "size", "d", "t", root.place(lambda x: x.first).cast("int").alias("shard"))
    return gapless(placed, ["shard"], "d", ["t"], 5000, "slot").drop("d", "t")
