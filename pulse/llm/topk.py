"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Candidates are dealt by a hash of id, vector and row number into blocks of about ``BLOCK_ROWS``; a block keeps, for each component, the list of its values
in descending order. A block and a block of queries meet in one task, which reads the lists from the end that
suits the sign of the query's component, all lists to the same depth. What has been read is known; for the
rest the value at the reading depth bounds a candidate's score from above and the list's far end from below.
The depth doubles until, for a query, no more than ``RESOLVE`` candidates have an upper bound that reaches
the k-th lower bound (nobody else can qualify); their scores are then resolved exactly. What is still open when the
lists end is exact by then. Blocks return their k best, from which the best of all are taken.

Scores are sums of integers in double precision: exact below 2**53 in size.

Cases: null ids, null vectors and those with null or non-finite components take no part; shorter vectors count as
zero-padded; a row with the query's id is never its candidate; a query id that occurs
more than once is answered once, for its smallest vector; repeated candidate rows are candidates of their
own; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import cut
from pulse.llm.vectors import best, dealt_to, named, pack, padded, unpack

BLOCK_ROWS = 4096
QUERY_ROWS = 256
RESOLVE = 64


class Lists:
    """A block's sorted lists: of each component, the rows by descending value and the values."""

    def __init__(self, matrix: np.ndarray):
        self.rows = np.argsort(-matrix, axis=0, kind="stable")
        self.values = np.take_along_axis(matrix, self.rows, axis=0)

    def read(self, depth: int, known: np.ndarray, bound: float) -> np.ndarray:
        """Values (rows x components) read from the top to ``depth``; ``bound`` row of values for what is not."""
        n, dims = self.values.shape
        known[:] = bound
        for c in range(dims):
            known[self.rows[:depth, c], c] = self.values[:depth, c]
        return known

    def read_up(self, depth: int, known: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The same from the bottom."""
        n, dims = self.values.shape
        known[:] = bound
        for c in range(dims):
            known[self.rows[n - depth:, c], c] = self.values[n - depth:, c]
        return known


def nra(ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
        resolve: int = RESOLVE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, candidate ids, exact scores): the k best candidates of each query in a block."""
    n = len(ids)
    if not n or not len(query_ids):
        return
    lists, open_ = Lists(matrix), np.arange(len(query_ids))
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    high, low = lists.values[0], lists.values[-1]
    known = np.empty_like(matrix)
    depth = max(k, n // 8)
    while len(open_):
        depth = min(n, depth)
        upper = up[open_] @ lists.read(depth, known, lists.values[depth - 1]).T
        lower = up[open_] @ lists.read(depth, known, low).T
        upper += down[open_] @ lists.read_up(depth, known, lists.values[n - depth]).T
        lower += down[open_] @ lists.read_up(depth, known, high).T
        own = ids[None, :] == query_ids[open_][:, None]
        upper[own] = lower[own] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
        still = []
        for i, q in enumerate(open_):
            may = np.flatnonzero((upper[i] >= kth[i]) & (upper[i] > -np.inf))
            if len(may) > resolve and depth < n:
                still.append(q)
                continue
            scores = matrix[may] @ queries[q]
            first = np.lexsort((ids[may], -scores))[:k]
            yield int(query_ids[q]), ids[may][first], scores[first]
        open_ = np.array(still, int)
        depth *= 2


def top_k(vectors: DataFrame, is_query: Column, k: int, dims: int, block_rows: int = BLOCK_ROWS,
          resolve: int = RESOLVE) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (id long, vector: usable array<double> of whole numbers)."""
    rows = cut(named(vectors).select("id", padded(F.col("vector"), dims).cast("array<double>").alias("vector"), is_query.alias("asks"),
                                     F.monotonically_increasing_id().alias("salt")))
    blocks = max(1, -(-rows.count() // block_rows))
    asking = rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    groups = max(1, -(-rows.where("asks").count() // QUERY_ROWS))
    dealt = rows.withColumn("block", dealt_to(blocks))
    packed = pack(dealt, ["block"], "<f8")
    asked = pack(asking.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups))), ["part"], "<f8")
    asked = asked.select("part", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cols = [batch.column(c)[r].as_py() for c in range(4)]
                ids, matrix = unpack(cols[0], cols[1], "<f8", dims)
                q_ids, queries = unpack(cols[2], cols[3], "<f8", dims)
                for q, found, scores in nra(ids, matrix, q_ids, queries, k, resolve):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), q, np.int64)), pa.array(found), pa.array(scores.astype(np.int64))],
                        ["query_id", "vec_id", "score"])

    # queries are copied for every block, but Spark plans with their size before that: unless told so, it may send all copies to the driver
    met = packed.join(asked.hint("merge"), "block").select("ids", "data", "q_ids", "q_data")
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    return best(found, k, [F.col("score").desc(), F.col("vec_id")]).select("query_id", "rank", "vec_id", "score")
