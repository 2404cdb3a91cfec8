"""Ranked lexical search by dense blocked matrix products.

Items (queries) are dealt into tiles of about ``TILE_BYTES`` of text. A tile's distinct terms are its vocabulary; documents
are read once for each tile and keep of their text only the vocabulary's term counts and their length. A group of
``GROUP`` items has a compact vocabulary of its own: its weights (terms x items) times the impacts of a block of documents
(documents x terms), both dense in float64, are the block's scores.

All numbers are whole. A product is exact while its sums stay below 2^53; where the largest possible sum of a group's
weights times the largest impact could pass that, the vocabulary is cut into tiles that cannot, and their products are
added up as 64-bit integers.

Each task keeps the ``k`` best documents of every item by (score, id), so ties at the end of the list are settled by id
whatever block they come from. Tasks' lists are merged in two steps: by item and a part of the tasks, then by item.

Score: a term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has
m = 50 + (50 n N) div L; a term that it holds tf times has the impact (10^9 tf) div (1000 tf + 20 m), below 10^6.
N counts the documents with a term, L their terms with repeats.

Cases: null or empty texts have no terms; only A-Z are lower-cased; an item counts each of its terms once; an item
without terms, or whose terms no document holds, has no row; repeated items are ranked each on its own, repeated documents
are documents of their own; null document ids come last among equal scores; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import cut

TILE_BYTES, GROUP, PARTS = 1 << 20, 64, 64
#: Bytes of a text that are split at a time, for very long texts.
PORTION = 1 << 20
IMPACT, EXACT = 10**6, 1 << 53


def _byte_map() -> bytes:
    """Separators to blanks, A-Z to a-z; digits, letters and all bytes of characters beyond ASCII stay."""
    return bytes(b if b >= 0x80 or chr(b).isalnum() and b < 0x80 and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 0x20 for b in range(256))


_BYTES = _byte_map()


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PORTION)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, tf): per document its number of terms, and places and counts of those in the vocabulary."""
    spread = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = spread.value.get
        for batch in batches:
            lengths, places, counts = [], [], []
            for text in batch.column(1).to_pylist():
                n, tally = 0, np.zeros(0, np.int64)
                for some in terms(text or ""):
                    n += len(some)
                    met = np.bincount(np.array([p for p in map(place, some) if p is not None], np.int64))
                    if len(met) < len(tally):
                        met, tally = tally, met
                    met[:len(tally)] += tally
                    tally = met
                here = np.flatnonzero(tally)
                lengths.append(n)
                places.append(here.astype(np.int32))
                counts.append(tally[here])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n", "at", "tf"])

    return docs.mapInArrow(count, "doc_id long, n long, at array<int>, tf array<long>")


class Group:
    """Some items: their compact vocabulary, and its tiles of weights (terms x items) whose products stay exact."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: np.ndarray, exact: int = EXACT):
        self.numbers = np.array([number for number, _ in items], np.int64)
        used = np.unique(np.concatenate([t for _, t in items]))
        used = used[weights[used] > 0]
        self.column = np.full(len(weights), -1, np.int32)
        self.column[used] = np.arange(len(used))
        self.matrix = np.zeros((len(used), len(items)))
        for j, (_, t) in enumerate(items):
            t = t[weights[t] > 0]
            self.matrix[self.column[t], j] = weights[t]
        most = weights[used].astype(object) * IMPACT
        self.cuts, total = [0], 0
        for i, bound in enumerate(most):
            if total and total + bound >= exact:
                self.cuts.append(i)
                total = 0
            total += bound
        self.cuts.append(len(used))

    def scores(self, rows: int, row: np.ndarray, at: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """(documents x items) of whole scores, from the sparse impacts of a block of documents."""
        column = self.column[at]
        mine = column >= 0
        dense = np.zeros((rows, len(self.matrix)))
        dense[row[mine], column[mine]] = impact[mine]
        out = np.zeros((rows, len(self.numbers)), np.int64)
        for low, high in zip(self.cuts, self.cuts[1:], strict=False):
            out += (dense[:, low:high] @ self.matrix[low:high]).astype(np.int64)
        return out


class Best:
    """The k best (score, id) of every item among the blocks seen so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.kept = [(np.zeros(0, np.int64),) * 3 for _ in range(items)]
        self.least = np.ones(items, np.int64)  # the score that a further document needs

    def add(self, scores: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        for j in np.flatnonzero((scores >= self.least).any(axis=0)):
            new = np.flatnonzero(scores[:, j] >= self.least[j])
            joined = [np.concatenate([old, x]) for old, x in zip(self.kept[j], (scores[new, j], unnamed[new], ids[new]), strict=True)]
            first = np.lexsort((joined[2], joined[1], -joined[0]))[:self.k]
            self.kept[j] = tuple(x[first] for x in joined)
            if len(first) == self.k:
                self.least[j] = self.kept[j][0][-1]


def _search(found: DataFrame, groups: list[Group], k: int, n_docs: int, all_terms: int) -> DataFrame:
    """(number, doc_id, score, part): each task's best documents of every item."""
    spread = found.sparkSession.sparkContext.broadcast(groups)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = spread.value
        best = [Best(len(g.numbers), k) for g in mine]
        for batch in batches:
            places = batch.column(2)
            at, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            row = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
            n = batch.column(1).to_numpy(zero_copy_only=False)
            m = 50 + (50 * n * n_docs) // all_terms
            impact = (10**9 * tf) // (1000 * tf + 20 * m[row])
            unnamed = np.asarray(batch.column(0).is_null().to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for group, kept in zip(mine, best, strict=True):
                kept.add(group.scores(batch.num_rows, row, at, impact), unnamed, ids)
        for group, kept in zip(mine, best, strict=True):
            for number, (scores, unnamed, ids) in zip(group.numbers, kept.kept, strict=True):
                if len(scores):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(scores), number)), pa.array(ids, mask=unnamed > 0), pa.array(scores)], ["number", "doc_id", "score"])

    out = found.mapInArrow(search, "number long, doc_id long, score long")
    return out.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))


def rank(docs: DataFrame, items: DataFrame, k: int, tile_bytes: int = TILE_BYTES, exact: int = EXACT) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = cut(items.select("item_id", "text").withColumn("number", F.monotonically_increasing_id()))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tiles = -(-size // tile_bytes)
    asked = items.withColumn("tile", F.pmod(F.xxhash64("number"), F.lit(max(1, tiles))))
    found = None
    for tile in range(tiles):
        vocabulary: dict[bytes, int] = {}
        listed = []
        for r in asked.where(F.col("tile") == tile).select("number", "text").orderBy("number").toLocalIterator():
            own = {vocabulary.setdefault(t, len(vocabulary)) for some in terms(r["text"] or "") for t in some}
            if own:
                listed.append((r["number"], np.array(sorted(own), np.int64)))
        kept = cut(counted(docs, vocabulary))
        n_docs, all_terms = kept.where(F.col("n") > 0).agg(F.count(F.lit(1)), F.sum("n")).first()
        if not listed or not n_docs:
            continue
        holding = np.zeros(len(vocabulary), np.int64)
        for at, df in kept.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df")).collect():  # the vocabulary
            holding[at] = df
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * holding + 1))).astype(np.int64)
        groups = [Group(listed[i:i + GROUP], weights, exact) for i in range(0, len(listed), GROUP)]
        some = _search(kept, groups, k, n_docs, all_terms)
        found = some if found is None else found.unionAll(some)
    if found is None:
        return items.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    partial = F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))
    found = found.withColumn("rank", partial).where(F.col("rank") <= k).drop("rank")
    place = F.row_number().over(Window.partitionBy("number").orderBy(*order))
    found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found.join(items.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
