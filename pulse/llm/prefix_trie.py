"""Prefix tree of conversations by fixed-length block hashing.

A node of the tree is a distinct sequence of first d turns; conversations that start with it are its members. Turns are
hashed together with their place, and a prefix's digest is the exclusive-or of its turns' hashes (two of 64 bits),
so digests of any run of turns are made in parallel and combined.

1. Conversations are cut into blocks of ``BLOCK`` turns. A block's digest and the digest of all blocks before it group
   conversations block by block: equal (digest before, own digest) means equal turns up to the block's end.
2. Where every conversation that goes on after a block boundary goes on with the same block, that block is one
   unbranched run of nodes: no turn in it is compared. Only blocks where siblings diverge are refined, turn by turn, for one
   conversation of each kind of block and not for all members.
3. A node is named by its smallest member ("owner") and its depth. The nodes that a conversation owns are the lower end
   of its path, a chain. Sums over subtrees are sums along chains, plus what each side chain adds to the owners on
   its own path: no pass over depths, no recursion.

Running sums along a conversation or a chain are taken in two steps, over runs of ``RUN`` rows and inside them, so a
conversation that holds a third of all turns is a chain of small groups.

Cases: null conversation ids take no part; turns are ordered by number (null first), equal numbers by the digest of role
and text, so that repeated rows are turns one after the other; null role or text is empty; a conversation
without turns belongs to the root; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.ranking import numbered
from pulse.llm.common import cut
from pulse.llm.mixing import words

#: Turns in a block (a power of two, given by its bits) and rows in a step of a running sum.
BLOCK_BITS, RUN_BITS = 2, 10
BLOCK = 1 << BLOCK_BITS
KIND = ["b", "b1", "b2", "x1", "x2", "n"]  # a kind of block: place, digest before, own digest, turns


def turns_of(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, digest, words): the turns of every conversation, numbered from 0 in order."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)))
    small = rows.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), words(t).alias("words"))
    return numbered(small, [F.col("turn").asc_nulls_first(), F.col("digest").asc()], ["conv"], "pos").drop("turn")


def with_shared_heads(turns: DataFrame, every: int, longest: int, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of another one: (turns, conversations (conv)).

    Conversation c gets the first ``taken`` turns (an expression of ``conv``, at most ``longest``) of conversation
    c - c % every, as far as there are any, then its own turns after its first ``taken``.
    """
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("has"))
    heads = turns.where((F.col("conv") % every == 0) & (F.col("pos") < longest))
    heads = cut(heads.withColumnRenamed("conv", "origin"))
    there = heads.groupBy("origin").agg(F.count(F.lit(1)).alias("there"))
    convs = convs.select("conv", (F.col("conv") - F.col("conv") % every).alias("origin"), taken.cast("long").alias("taken"))
    convs = cut(convs.join(there, "origin", "left").withColumn("there", F.coalesce("there", F.lit(0))))
    lent = (convs.where(F.col("taken") > 0).select("conv", "origin", "taken").join(heads, "origin")
            .where(F.col("pos") < F.col("taken")).select("conv", "pos", "digest", "words"))
    # own turns move up where the origin has fewer turns than are taken
    gaps = convs.where(F.col("there") < F.col("taken")).select("conv", (F.col("taken") - F.col("there")).alias("gap"))
    own = turns.where(F.col("pos") >= taken).join(gaps, "conv", "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "digest", "words")
    return own.unionAll(lent), convs.select("conv")


def running(df: DataFrame, group: str, at: str, sums: dict[str, Column], down: bool = False) -> DataFrame:
    """``df`` with running sums (``down``: from the largest ``at`` on) of the columns ``sums`` (name: column), the row included."""
    step = F.shiftright(at, RUN_BITS)
    order = (lambda c: F.col(c).desc()) if down else (lambda c: F.col(c).asc())
    df = df.withColumn("_run", step)
    totals = df.groupBy(group, "_run").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(group).orderBy(order("_run")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, "_run", *[F.sum(f"_t_{n}").over(before).alias(f"_t_{n}") for n in sums])
    totals = totals.where(F.greatest(*[F.abs(F.coalesce(f"_t_{n}", F.lit(0))) for n in sums], F.lit(0)) > 0)
    inside = Window.partitionBy(group, "_run").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()]).join(totals, [group, "_run"], "left")
    return out.select(*[c for c in df.columns if c != "_run"],
                      *[(F.col(f"_i_{n}") + F.coalesce(f"_t_{n}", F.lit(0))).alias(n) for n in sums])


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv, b, b1, b2, x1, x2, n): every block with the digest of what lies before it."""
    blocks = turns.groupBy("conv", "b").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("run", F.shiftright("b", RUN_BITS))
    runs = blocks.groupBy("conv", "run").agg(F.bit_xor("x1").alias("r1"), F.bit_xor("x2").alias("r2"))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "run", *[F.bit_xor(c).over(earlier).alias(c) for c in ("r1", "r2")]).where(F.col("run") > 0)
    inside = Window.partitionBy("conv", "run").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("*", *[F.coalesce(F.bit_xor(f"x{i}").over(inside), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    blocks = blocks.join(runs, ["conv", "run"], "left")
    before = [F.col(f"b{i}").bitwiseXOR(F.coalesce(f"r{i}", F.lit(0))).alias(f"b{i}") for i in (1, 2)]
    return blocks.select("conv", "b", *before, "x1", "x2", "n")


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree over ``turns`` (conv, pos from 0 without gaps, digest, words) of ``convs`` (conv): (nodes, ends).

    nodes: owner, depth, parent (its owner; null for the root), n_convs, n_children, n_leaves, saved (the members
    but one of every node below and including it, times the words of its last turn); ends: conv, owner, depth of
    the node where each conversation ends.
    """
    turns = cut(turns.select("conv", "pos", F.shiftright("pos", BLOCK_BITS).alias("b"), "words",
                             *[F.xxhash64(F.lit(i), "pos", "digest").alias(f"x{i}") for i in (1, 2)]))
    convs = cut(convs)
    blocks = cut(_blocks(turns))
    kinds = cut(blocks.groupBy(*KIND).agg(F.count(F.lit(1)).alias("convs"), F.min("conv").alias("owner")))
    root = cut(convs.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs")), 1)

    # where all that goes on goes on alike, the aggregate itself is the only kind: no join on a boundary's digest
    rest = [c for c in (*KIND, "convs", "owner") if c not in ("b", "b1", "b2")]
    alone = (kinds.groupBy("b", "b1", "b2").agg(F.count(F.lit(1)).alias("many"), F.max(F.struct(*rest)).alias("k")).where(F.col("many") == 1)
             .select("b", F.col("k.owner").alias("owner")).withColumn("alone", F.lit(True)))
    kinds = kinds.join(alone, ["owner", "b"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    one = cut(turns.withColumnRenamed("conv", "owner").join(
        kinds.select("owner", "b", "b1", "b2", "convs", "alone"), ["owner", "b"]))  # the turns of one conversation of each kind

    inside = Window.partitionBy("owner", "b").orderBy("pos")
    split = one.where(~F.col("alone")).select("*", *[
        F.col(f"b{i}").bitwiseXOR(F.bit_xor(f"x{i}").over(inside)).alias(f"p{i}") for i in (1, 2)])
    refined = split.groupBy("pos", "p1", "p2").agg(F.sum("convs").alias("n_convs"), F.min("owner").alias("node"))
    split = split.join(refined, ["pos", "p1", "p2"])
    columns = ["owner", "b", "b1", "b2", "pos", "words", "n_convs", "node"]
    places = cut(split.select(*columns).unionAll(
        one.where("alone").select("owner", "b", "b1", "b2", "pos", "words", F.col("convs").alias("n_convs"), F.col("owner").alias("node"))))

    # nodes: the places of their owners; the parent is the place before, or the node at the block's start
    first = F.col("pos").bitwiseAND(F.lit(BLOCK - 1)) == 0
    nodes = places.withColumn("above", F.lag("node").over(inside)).where(F.col("node") == F.col("owner"))
    full = kinds.where(F.col("n") == BLOCK).select(
        (F.col("b") + 1).alias("b"), *[F.col(f"b{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"b{i}") for i in (1, 2)], F.col("owner").alias("start"))
    start = nodes.where(first).join(full, ["b", "b1", "b2"], "left")
    start = start.crossJoin(F.broadcast(root.select(F.col("owner").alias("top"))))  # one row
    start = start.select("owner", "pos", "n_convs", "words", F.when(F.col("b") == 0, F.col("top")).otherwise(F.col("start")).alias("parent"))
    nodes = cut(start.unionAll(nodes.where(~first).select("owner", "pos", "n_convs", "words", F.col("above").alias("parent")))
                .withColumn("depth", F.col("pos") + 1))
    below = nodes.groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    below = cut(below)
    nodes = nodes.join(below, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut(nodes.select("owner", "depth", "parent", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("words")).alias("saves"),
                             (F.col("n_children") == 0).cast("long").alias("leaf")))

    # the owners on the path of every conversation, by blocks
    met = places.groupBy("owner", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("met"))  # BLOCK rows at most
    paths = blocks.join(kinds.select(*KIND, "owner").join(met, ["owner", "b"]), KIND)
    paths = cut(paths.select("conv", "met"))
    last = F.element_at("met", -1)
    ends = paths.groupBy("conv").agg(F.max(last).alias("last"))
    ends = convs.join(ends, "conv", "left").crossJoin(F.broadcast(root.select(F.col("owner").alias("top"))))
    ends = cut(ends.select("conv", F.coalesce("last.node", "top").alias("owner"), F.coalesce(F.col("last.pos") + 1, F.lit(0)).alias("depth")))

    # what each chain saves and its leaf count for every owner on its own path
    chains = nodes.groupBy("owner").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    others = F.filter("met", lambda m: m["node"] != F.col("conv"))
    side = paths.select("conv", F.explode(others).alias("m")).groupBy("conv", F.col("m.node").alias("node")).agg((F.max("m.pos") + 1).alias("depth"))
    side = (side.join(chains.withColumnRenamed("owner", "conv"), "conv").groupBy(F.col("node").alias("owner"), "depth")
            .agg(F.sum("saves").alias("more_saves"), F.sum("leaf").alias("more_leaves")))
    whole = nodes.join(side, ["owner", "depth"], "left")
    whole = running(whole, "owner", "depth", {
        "saved": F.col("saves") + F.coalesce("more_saves", F.lit(0)), "n_leaves": F.col("leaf") + F.coalesce("more_leaves", F.lit(0))}, down=True)
    columns = ["owner", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved"]
    all_below = nodes.agg(F.coalesce(F.sum("saves"), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"),
                          F.count_if(F.col("depth") == 1).alias("n_children"))
    top = root.where(F.col("n_convs") > 0).crossJoin(F.broadcast(all_below)).select(
        "owner", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", "n_children",
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), "saved")
    return whole.select(*columns).unionAll(top.select(*columns)), ends


def listed_sha(members: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, sha): SHA-256 of each group's values (long), ascending and comma-joined.

    Values are sorted over range partitions and joined to short pieces; one task then reads a group's pieces in
    order, a batch at a time, so a group's list is never held whole.
    """
    keys = [*group, value]
    laid = members.select(*[F.col(c).cast("long").alias(c) for c in keys]).repartitionByRange(*keys).sortWithinPartitions(*keys)
    named = ", ".join(f"{c} long" for c in group)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            runs: list[tuple] = []
            for *key, v in zip(*columns, strict=True):
                if not runs or runs[-1][0] != key:
                    runs.append((key, v, []))
                runs[-1][2].append(str(v))
            if runs:
                out = [pa.array([r[0][i] for r in runs], pa.int64()) for i in range(len(group))]
                yield pa.RecordBatch.from_arrays([*out, pa.array([r[1] for r in runs], pa.int64()), pa.array([",".join(r[2]) for r in runs])],
                                                 [*group, "least", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            out = [pa.array([d[0][i] for d in done], pa.int64()) for i in range(len(group))]
            return pa.RecordBatch.from_arrays([*out, pa.array([d[1] for d in done], pa.string())], [*group, "sha"])

        for batch in batches:
            done: list[tuple] = []
            for *here, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or here != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = here, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            yield batch_of(done)
        if state is not None:
            yield batch_of([(key, state.hexdigest())])

    cutup = laid.mapInArrow(pieces, f"{named}, least long, piece string")
    return cutup.repartition(*group).sortWithinPartitions(*group, "least").mapInArrow(hashed, f"{named}, sha string")
