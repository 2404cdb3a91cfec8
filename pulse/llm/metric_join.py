"""Near-duplicate vectors by an exact metric range join.

Two vectors link if their cosine is at least ``least``: if the distance of their directions is at most
r = sqrt(2 - 2 least). Pivots partition the directions: each belongs to its nearest pivot's cell. A vector of a
later cell is copied to an earlier one if the triangle inequality leaves room for a partner there: with d its distance to
that cell's pivot, d <= (distance to its own pivot) + 2 r, d <= (radius of the cell) + r, and r reaches over the
plane halfway between both pivots. So every link is met in exactly one cell, and cells are joined independently.

Inside a cell, vectors within r / 2 of the pivot (its core) all link with each other, again by the triangle inequality:
they are counted and joined without a test, so a group of near copies that holds a third of all vectors costs a sum. All
other pairs of a cell are tested in blocks of ``BLOCK_ROWS``, each pair of blocks by a task of its own: in float32
first, and again in double precision where that is too coarse to tell. A task returns counts and one row for each
linked vector (the smallest vector that it is connected with there), never pairs.

Equal vectors are one node with a count from the start. Links become components by distributed label propagation.

Pivots come from a bounded sample (``SAMPLE`` vectors, by hash): the centres of its dense regions, at least 2 r apart, and
further vectors as the table grows. They decide how fast the join is, never what it finds. Where directions
have no structure, as in noise of many dimensions, all cells border on each other and every pair is tested.

Cases: null or zero vectors and those with null or non-finite components link with nothing and are kept; shorter
vectors count as zero-padded; rows are vectors of their own, whether ids or vectors repeat; null ids link
like others, but never name a component unless it has no other id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import cut
from pulse.llm.near_dup import connected
from pulse.llm.vectors import padded, usable

SAMPLE, DENSE, MAX_PIVOTS, CELL_ROWS, BLOCK_ROWS = 4096, 8, 1024, 16384, 4096
#: Slack of distances, far above rounding errors of double precision: it adds copies and tests, never links.
SLACK = 1e-9
CORE, HOME, COPY = 0, 1, 2


def directions(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # before squares, which may overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def pivots_of(sample: np.ndarray, reach: float, more: int) -> np.ndarray:
    """Centres of the sample's dense regions at least two reaches apart, then up to ``more`` other vectors."""
    if not len(sample):
        return sample
    cosines = sample @ sample.T
    near = (apart(cosines) <= reach).sum(axis=1)
    chosen: list[int] = []
    free = np.ones(len(sample), bool)
    for i in np.argsort(-near, kind="stable"):
        dense = near[i] >= DENSE
        if not free[i] or len(chosen) >= MAX_PIVOTS or not dense and more <= 0:
            continue
        more -= not dense
        chosen.append(i)
        free &= apart(cosines[i]) > 2 * reach
    pivots = sample[chosen or [0]]
    for _ in range(2):  # towards the centres
        home = (sample @ pivots.T).argmax(axis=1)
        for c in range(len(pivots)):
            close = sample[(home == c) & (apart(sample @ pivots[c]) <= reach)]
            middle = close.sum(axis=0) if len(close) else pivots[c]
            if np.linalg.norm(middle) > 0:
                pivots[c] = middle / np.linalg.norm(middle)
    return pivots


def _cells(nodes: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """(node, cell, d): each node's nearest pivot and its distance."""
    spread = nodes.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosines = directions(_matrix(batch.column(1), dims)) @ spread.value.T
            home = cosines.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home.astype(np.int32)), pa.array(apart(cosines.max(axis=1)))],
                                             ["node", "cell", "d"])

    return nodes.select("node", "vector").mapInArrow(nearest, "node long, cell int, d double")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def _dealt(nodes: DataFrame, pivots: np.ndarray, radius: np.ndarray, reach: float, dims: int) -> DataFrame:
    """(cell, kind, node, m, vector): each node in its own cell, and its copies in earlier cells that it may link to."""
    spread = nodes.sparkSession.sparkContext.broadcast((pivots, radius, apart(pivots @ pivots.T)))
    kind = dict(nodes.dtypes)["vector"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, radii, between = spread.value
        for batch in batches:
            d = apart(directions(_matrix(batch.column(2), dims)) @ at.T)
            own = np.arange(len(d))
            home = d.argmin(axis=1)
            nearest = d[own, home][:, None]
            beyond = (d * d - nearest * nearest) <= 2 * (reach + SLACK) * between[home] + SLACK
            copied = (d <= nearest + 2 * reach + SLACK) & (d <= radii + reach + SLACK) & beyond & (np.arange(len(at)) < home[:, None])
            row, cell = np.nonzero(copied)
            kinds = np.where(nearest[:, 0] <= reach / 2 - SLACK, CORE, HOME)
            rows = pa.array(np.concatenate([own, row]))
            some = batch.take(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(np.concatenate([kinds, np.full(len(row), COPY)]).astype(np.int32)),
                 *some.columns], ["cell", "kind", "node", "m", "vector"])

    return nodes.select("node", "m", "vector").mapInArrow(deal, f"cell int, kind int, node long, m long, vector {kind}")


def _packed(placed: DataFrame, element: str) -> DataFrame:
    """(cell, block, nodes, ms, data): a row for each block, of bounded size."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [key[0]], "block": [key[1]], "nodes": [rows["node"].to_numpy("<i8").tobytes()],
                             "ms": [rows["m"].to_numpy("<i8").tobytes()], "data": [np.stack(rows["vector"].to_list()).astype(element).tobytes()]})

    return placed.select("cell", "block", "node", "m", "vector").groupBy("cell", "block").applyInPandas(
        one, "cell int, block long, nodes binary, ms binary, data binary")


def links_between(x: np.ndarray, y: np.ndarray, least: float, rows: int = 1024) -> np.ndarray:
    """Whether each direction of x and of y have a cosine of ``least`` or more, in double precision."""
    out = np.zeros((len(x), len(y)), bool)
    few_x, few_y = x.astype(np.float32), y.astype(np.float32)
    margin = np.float32(1e-6 + 2.5e-7 * x.shape[1])
    for at in range(0, len(x), rows):
        rough = few_x[at:at + rows] @ few_y.T
        out[at:at + rows] = rough >= least + margin
        i, j = np.nonzero(np.abs(rough - np.float32(least)) <= margin)
        for part in range(0, len(i), 1 << 16):
            a, b = i[part:part + (1 << 16)], j[part:part + (1 << 16)]
            out[at + a, b] = np.einsum("ij,ij->i", x[at + a], y[b]) >= least
    return out


def joined(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of both sides, the smallest node that each is connected with by ``linked`` (left x right)."""
    out = [left.copy(), right.copy()]
    open_ = [linked.any(axis=1), linked.any(axis=0)]
    for i in np.flatnonzero(open_[0]):
        if not open_[0][i]:
            continue
        member = [np.array([i]), np.zeros(0, int)]
        open_[0][i] = False
        side, new = 0, member[0]
        while len(new):
            met = linked[new].any(axis=0) if side == 0 else linked[:, new].any(axis=1)
            side = 1 - side
            new = np.flatnonzero(met & open_[side])
            open_[side][new] = False
            member[side] = np.concatenate([member[side], new])
        root = min(left[member[0]].min(), right[member[1]].min())
        out[0][member[0]] = root
        out[1][member[1]] = root
    return out[0], out[1]


def _tested(placed: DataFrame, blocks: DataFrame, least: float, dims: int, element: str) -> DataFrame:
    """(node, links, root) of what the pairs of blocks show; ``blocks``: cell, first, inner, all (blocks by kind, added up)."""
    packs = _packed(placed, element).join(F.broadcast(blocks), "cell")  # a row for each cell
    each = lambda low, high: F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>")))
    block, core, inner, every = (F.col(c) for c in ("block", "first", "inner", "all"))
    left = packs.where(block < inner).select("cell", block.alias("x"), each(F.greatest(block, core), every - 1).alias("y"), "nodes", "ms", "data")
    right = packs.where(block >= core).select(
        "cell", each(F.lit(0).cast("long"), F.least(block, inner - 1)).alias("x"), block.alias("y"),
        F.col("nodes").alias("nodes_y"), F.col("ms").alias("ms_y"), F.col("data").alias("data_y"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same, *held = (batch.column(c)[r].as_py() for c in range(7))
                (nodes, ms), (nodes_y, ms_y) = ((np.frombuffer(b, "<i8") for b in held[i:i + 2]) for i in (0, 3))
                x, y = (directions(np.frombuffer(held[i], element).reshape(-1, dims)) for i in (2, 5))
                linked = links_between(x, y, least)
                if same:
                    np.fill_diagonal(linked, False)
                roots = joined(linked, nodes, nodes_y)
                out = [(nodes, linked @ ms_y, roots[0])]
                if not same:
                    out.append((nodes_y, linked.T @ ms, roots[1]))
                for names, links, root in out:
                    some = links > 0
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])],
                                                     ["node", "links", "root"])

    met = left.join(right, ["cell", "x", "y"]).select(
        (F.col("x") == F.col("y")).alias("same"), "nodes", "ms", "data", "nodes_y", "ms_y", "data_y")
    return met.mapInArrow(test, "node long, links long, root long")


def components(vectors: DataFrame, least: float = 0.9, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, n_links, component_id) for every row of ``vectors`` (id long, vector array<float or double>)."""
    good = usable(F.col("vector"))
    good = good & F.when(good, F.exists("vector", lambda x: x != 0)).otherwise(False)
    wide = F.transform("vector", lambda x: x.cast("double") + 0.0)  # one zero
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vector", good.alias("good"))
    dims = rows.where("good").agg(F.max(F.size("vector"))).first()[0] or 1
    element = "<f4" if dict(vectors.dtypes)["vector"] == "array<float>" else "<f8"
    kind = "array<float>" if element == "<f4" else "array<double>"
    rows = cut(rows.select("id", "good", F.when(F.col("good"), padded(wide, dims).cast(kind)).alias("vector")))
    name = [F.when(F.col("good"), F.xxhash64(F.lit(i), "vector")).alias(f"k{i}") for i in (1, 2)]
    named = rows.select("id", "vector", *name)
    nodes = cut(named.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(
        F.first("vector").alias("vector"), F.count(F.lit(1)).alias("m"), F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    reach = float(np.sqrt(2 - 2 * least))
    sample = [r["vector"] for r in nodes.orderBy("k1", "k2").limit(SAMPLE).select("vector").collect()]
    pivots = pivots_of(directions(np.array(sample, float).reshape(len(sample), dims)), reach, -(-nodes.count() // cell_rows))
    if not len(pivots):
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))

    near = _cells(nodes, pivots, dims).groupBy("cell").agg(F.max("d").alias("d")).collect()  # a row for each pivot
    radius = np.full(len(pivots), -10.0)  # nobody's cell takes no copies
    for r in near:
        radius[r["cell"]] = r["d"]
    placed = cut(_dealt(nodes, pivots, radius, reach, dims))
    sizes = [F.ceil(F.count_if(F.col("kind") == k) / block_rows).alias(f"n{k}") for k in (CORE, HOME, COPY)]
    blocks = cut(placed.groupBy("cell").agg(*sizes).select(
        "cell", F.col("n0").alias("first"), (F.col("n0") + F.col("n1")).alias("inner"), (F.col("n0") + F.col("n1") + F.col("n2")).alias("all")), 1)
    low = F.when(F.col("kind") == CORE, F.lit(0)).when(F.col("kind") == HOME, F.col("first")).otherwise(F.col("inner"))
    high = F.when(F.col("kind") == CORE, F.col("first")).when(F.col("kind") == HOME, F.col("inner")).otherwise(F.col("all"))
    block = low + F.pmod(F.xxhash64("node"), high - low)
    tested = _tested(placed.join(F.broadcast(blocks), "cell").withColumn("block", block), blocks, least, dims, element)
    core = placed.where(F.col("kind") == CORE)
    whole = core.groupBy("cell").agg(F.sum("m").alias("total"), F.min("node").alias("root"))  # a row for each pivot
    alike = core.join(F.broadcast(whole), "cell").select("node", (F.col("total") - F.col("m")).alias("links"), "root")
    found = cut(tested.unionAll(alike))

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where(F.col("node") != F.col("root")).select(F.col("node").alias("x"), F.col("root").alias("y"))
    labels = connected(edges, max(1, found.count() // 1_000_000)).select(F.col("v").alias("node"), "label")
    nodes = nodes.select("k1", "k2", "m", "least", "node").join(labels, "node", "left").join(counts, "node", "left")
    nodes = cut(nodes.withColumn("label", F.coalesce("label", "node")))
    least_id = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least_id, "label").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    return named.join(nodes, ["k1", "k2"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
