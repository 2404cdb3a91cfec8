"""Approximate nearest neighbours by cross-polytope hashing.

A hash function rotates unit vectors pseudo-randomly (``ROUNDS`` times: random signs, then a fast Hadamard transform) and
assigns them to the nearest of the 2d signed axes. A table concatenates ``width`` functions, so a bucket is named by as many
axes, and the number of buckets grows with the table: ``width`` is the rounded logarithm to base 2d of the rows by ``FILL``
(at least 1). Vectors lie in one bucket of every table; a query looks, in each table, into the buckets that are nearest to it
by the sum of squared differences between its best component and those of the bucket's axes (multiprobe). ``tables`` and
``probes`` are meant for one function; each further one doubles the tables and takes ``probes`` times the looks. Candidates
are reranked by exact Euclidean distance on the original vectors.

Every row is indexed. Buckets are dealt by a hash of their names to cells of about ``CHUNK_ROWS`` rows; a query is one row of
each cell that it looks into, with its vector and the list of its looks there. Rows and queries of a cell are counted: one
with more than twice ``CHUNK_ROWS`` rows (a hot bucket), or ``ASKED_ROWS`` queries, is cut into pieces of either, and each
piece of rows meets each piece of queries. That is one task's work, which returns the k nearest of each query. Pairs are
never rows.

Buckets may hold fewer than k candidates for a query: in small tables, or far from a narrow cluster. Queries left with
fewer than min(k, candidates) neighbours are searched exactly: they meet every row, in blocks of ``CHUNK_ROWS``. Their
cost is their number times the table's rows; the others never take part in it. So every query has min(k, candidates)
neighbours; what the hashing may still miss is a nearer one, not a place in the list.

Cases: null ids, null vectors, zero vectors and those with null or non-finite components take no part; shorter vectors count
as zero-padded; a row with the query's id is never its candidate; a query id that occurs more than once is
answered once, for its smallest vector; repeated candidate rows are candidates of their own; equal distances go to the
smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import cut
from pulse.llm.vectors import best, dealt_to, named, pack, padded, unpack

ROUNDS = 3
CHUNK_ROWS = 1 << 16
QUERY_ROWS = 4096
ASKED_ROWS = 1 << 16
#: Rows that looks meet at a time in a task, as vectors side by side.
MET_ROWS = 1 << 15
FILL = 8
FOUND = "query_id long, vec_id long, salt long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the columns (a power of two long), orthonormal."""
    dims, columns = x.shape
    width = 1
    while width < dims:
        y, z = x.reshape(dims // (2 * width), 2, width, columns), np.empty((dims // (2 * width), 2, width, columns))
        np.add(y[:, 0], y[:, 1], out=z[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=z[:, 1])
        x = z.reshape(dims, columns)
        width *= 2
    return x / np.sqrt(dims)


def functions_for(rows: int, dims: int) -> int:
    """How many hash functions name a bucket of a table of so many rows."""
    return max(1, round(math.log(max(rows, 1) / FILL, 2 * _axes(dims))))


def _axes(dims: int) -> int:
    return 1 << max(0, dims - 1).bit_length()


def rotated(unit: np.ndarray, table: int, function: int, seed: int) -> np.ndarray:
    """The products of each unit vector with the signed axes after the function's rotation."""
    dims = _axes(unit.shape[1])
    x = np.zeros((dims, len(unit)))  # vectors are columns: sums and differences run over all of them at once
    x[:unit.shape[1]] = unit.T
    random = np.random.default_rng([seed, table, function])
    for _ in range(ROUNDS):
        x = hadamard(x * random.choice([-1.0, 1.0], dims)[:, None])
    return np.concatenate([x, -x]).T


def nearest_buckets(unit: np.ndarray, table: int, width: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes`` nearest buckets of each unit vector in a table (fewer if there are not so many), nearest first."""
    codes, costs = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for function in range(width):
        sides = rotated(unit, table, function, seed)
        if probes == 1:
            codes = codes * sides.shape[1] + sides.argmax(axis=1)[:, None]
            continue
        order = np.argsort(-sides, axis=1, kind="stable")[:, :probes]
        near = np.take_along_axis(sides, order, axis=1)
        # the nearest combinations of all functions so far begin with nearest combinations of those before
        costs = (costs[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(len(unit), -1)
        codes = (codes[:, :, None] * sides.shape[1] + order[:, None, :]).reshape(len(unit), -1)
        first = np.argsort(costs, axis=1, kind="stable")[:, :probes]
        costs, codes = np.take_along_axis(costs, first, axis=1), np.take_along_axis(codes, first, axis=1)
    return codes


def _cells(names: np.ndarray, cells: int) -> np.ndarray:
    mixed = names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(cells)).astype(np.int64)


def _dealt(rows: DataFrame, dims: int, tables: int, width: int, probes: int, seed: int, cells: int) -> DataFrame:
    """``rows`` (vector) in the cells of their ``probes`` buckets of each table: a row for each cell, with ``names``.

    A name holds table and axes. Should so many axes not fit into 64 bits, buckets that share a name are one bucket.
    """
    some = 64 if probes > 1 else 4096  # a query has very many looks

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, some):
                batch = whole.slice(first, some)
                x = np.array(batch.column("vector").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, dims)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # before squares, which may overflow
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                names = np.concatenate([nearest_buckets(x, t, width, probes, seed) * tables + t for t in range(tables)], axis=1)
                row, cell = np.repeat(np.arange(len(x)), names.shape[1]), _cells(names.ravel(), cells)
                order = np.lexsort((cell, row))
                row, cell = row[order], cell[order]
                starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])))
                listed = pa.ListArray.from_arrays(np.append(starts, len(row)).astype(np.int32), names.ravel()[order])
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row[starts])).columns, pa.array(cell[starts]), listed],
                                                 [*batch.schema.names, "cell", "names"])

    return rows.mapInArrow(deal, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "cell long, names array<bigint>"]))


def closest(ids: np.ndarray, salts: np.ndarray, x: np.ndarray, q: int, v: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, id, salt, distance) of the k rows nearest to ``v``, ties to the smaller id, without those named ``q``."""
    apart = x - v
    far = np.sqrt((apart * apart).sum(axis=1))
    may = np.flatnonzero(ids != q)
    if len(may) > k:
        may = may[far[may] <= np.partition(far[may], k - 1)[k - 1]]
    first = may[np.lexsort((salts[may], ids[may], far[may]))[:k]]
    return np.full(len(first), q), ids[first], salts[first], far[first]


def _first(q: np.ndarray, ids: np.ndarray, salts: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest rows of each query, each once: query, id, salt, distance."""
    order = np.lexsort((salts, ids, far, q))
    q, salts = q[order], salts[order]
    once = np.append(True, (q[1:] != q[:-1]) | (salts[1:] != salts[:-1]))[:len(q)]  # a row's distance is the same in all tables
    order, q, salts = order[once], q[once], salts[once]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], ids[order[top]], salts[top], far[order[top]]


def _pieces(count: str, most: int) -> Column:
    return F.ceil(F.col(count) / most).cast("long")


def search(vectors: DataFrame, is_query: Column, k: int, dims: int, tables: int = 6, probes: int = 16, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (id long, vector: usable and not zero)."""
    kind = "<f4" if dict(vectors.dtypes)["vector"] == "array<float>" else "<f8"
    element = "array<float>" if kind == "<f4" else "array<double>"
    rows = cut(named(vectors).select("id", padded(F.col("vector"), dims).cast(element).alias("vector"), is_query.alias("asks"),
                                     F.monotonically_increasing_id().alias("salt")))
    total = rows.count()
    chunks = max(1, -(-total // CHUNK_ROWS))
    asking = cut(rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector")))
    width = functions_for(total, dims)
    tables, probes = tables << (width - 1), probes ** width
    cells = max(1, -(-total * tables // CHUNK_ROWS))
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = cut(_dealt(rows.select("id", "vector", "salt"), dims, tables, width, 1, seed, cells))
    looks = cut(_dealt(asking.repartition(max(1, min(tasks, -(-asking.count() // 64)))), dims, tables, width, probes, seed, cells))
    # the pieces of each cell
    held = index.groupBy("cell").agg(F.sum(F.size("names")).alias("held"))
    asked = looks.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    grid = cut(held.join(asked, "cell").select("cell", _pieces("held", 2 * CHUNK_ROWS).alias("pieces"), _pieces("asked", ASKED_ROWS).alias("packs")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    index = (index.join(grid, "cell").withColumn("piece", F.pmod(F.xxhash64("salt"), "pieces")).withColumn("pack", every("packs"))
             .select("cell", "piece", "pack", "names", "id", "vector", "salt"))
    looks = (looks.join(grid, "cell").withColumn("pack", F.pmod(F.xxhash64("id"), "packs")).withColumn("piece", every("pieces"))
             .select("cell", "piece", "pack", "names", "id", "vector"))

    def meet(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [tuple(np.zeros(0, t) for t in ("i8", "i8", "i8", "f8"))]
        if len(held) and len(asked):
            ids, salts, q_ids = held["id"].to_numpy(), held["salt"].to_numpy(), asked["id"].to_numpy()
            x, q = (np.stack(f["vector"].to_list()).astype(float) for f in (held, asked))
            of, looked = (np.concatenate(f["names"].to_list()) for f in (held, asked))
            at_row, by = (np.repeat(np.arange(len(f)), f["names"].map(len)) for f in (held, asked))
            order = np.argsort(of, kind="stable")
            of, at_row = of[order], at_row[order]
            first = np.searchsorted(of, looked)
            sizes = np.searchsorted(of, looked, "right") - first
            ends = np.cumsum(sizes)
            at = 0
            while at < len(looked):  # looks that meet about MET_ROWS rows at a time, one look at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MET_ROWS, "right")))
                n = sizes[at:to]
                look = np.repeat(by[at:to], n)
                row = at_row[np.repeat(first[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                other = ids[row] != q_ids[look]
                look, row = look[other], row[other]
                apart = x[row] - q[look]
                out.append(_first(q_ids[look], ids[row], salts[row], np.sqrt((apart * apart).sum(axis=1)), k))
                at = to
        found = _first(*(np.concatenate(c) for c in zip(*out, strict=True)), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "salt", "score"), found, strict=True)))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cols = [batch.column(c)[r].as_py() for c in range(5)]
                ids, x = unpack(cols[0], cols[1], kind, dims)
                q_ids, queries = unpack(cols[3], cols[4], kind, dims)
                near = ids, np.frombuffer(cols[2], "<i8"), x.astype(float)
                out = [closest(*near, q, v, k) for q, v in zip(q_ids, queries.astype(float), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 ["query_id", "vec_id", "salt", "score"])

    def nearest(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id", "salt").agg(F.min("score").alias("score"))  # met in several tables
        return best(once, k, [F.col("score"), F.col("vec_id"), F.col("salt")]).select("query_id", "rank", "vec_id", "score")

    places = ["cell", "piece", "pack"]
    found = cut(nearest(index.groupBy(*places).cogroup(looks.groupBy(*places)).applyInPandas(meet, FOUND)))
    # candidates of a query: all rows but those of its id
    own = rows.groupBy(F.col("id").alias("own_id")).agg(F.count(F.lit(1)).alias("own"))
    have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    short = (asking.join(have, F.col("id") == F.col("query_id"), "left").join(own, F.col("id") == F.col("own_id"))
             .where(F.coalesce("have", F.lit(0)) < F.least(F.lit(k).cast("long"), F.lit(total).cast("long") - F.col("own"))))
    short = cut(short.select("id", "vector"))
    parts = -(-short.count() // QUERY_ROWS)
    if not parts:
        return found
    packs = pack(short.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))), ["part"], kind)
    packs = packs.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    blocks = pack(rows.withColumn("chunk", dealt_to(chunks)), ["chunk"], kind).join(packs, "chunk")
    exact = nearest(blocks.select("ids", "data", "salts", "q_ids", "q_data").mapInArrow(rerank, FOUND))
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionAll(exact)
