"""Line deduplication by a sharded minimal perfect hash.

Lines that occur in many documents lose all their copies. Distinct lines are counted by Spark (each document
sends every distinct line once, as a 128-bit hash); the frequent ones are dealt to shards of a few thousand
keys, and each shard is built into a minimal perfect hash by "hash, displace": keys fall into small buckets, and
every bucket, largest first, gets a displacement that sends its keys to free slots (a bucket of one key names
its slot directly). The slots hold a 64-bit fingerprint and the document count. Documents then probe the
arrays; no table of lines is joined.

While the arrays take at most ``INDEX_MB`` (checked), every task gets them whole. Beyond that the documents'
line hashes are sent to the shards, salted so that a line in a third of all documents meets its shard in many
tasks, and only hits return.

Cases: a null text counts as one empty line and stays empty; lines whose key is shorter than ``min_chars``
never go; identical rows are documents of their own; an empty table gives an empty result. Hash collisions
need 128 equal bits in counting and 64 equal fingerprint bits in probing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import cut, payload

KEYS_PER_SHARD = 4096
INDEX_MB = 64
SALTS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
INDEX_TYPE = "shard long, n int, displace binary, prints binary, counts binary"


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of each line: ASCII white space stripped, A-Z lower-cased (bytes methods touch ASCII only)."""
    return [x.strip() for x in (text or b"").lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of each key's 128-bit hash."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, keys)), "<u8").reshape(-1, 2)


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(a, b, n): each distinct line key as two hash halves, with the number of documents that hold it."""

    def distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            for text in batch.column(0).cast(pa.large_binary()).to_pylist():
                keys.extend(k for k in set(line_keys(text)) if _long_enough(k, min_chars))
            h = hashes(keys).astype("<i8", copy=False).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], ["a", "b"])

    found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(distinct_lines, "a long, b long")
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _slot(a: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = (a ^ (d.astype(np.uint64) * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0x94D049BB133111EB)) >> np.uint64(11)) % n


def _print(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * _MIX) ^ b


def build_shard(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacements, fingerprints and counts of a minimal perfect hash over the distinct keys (a, b)."""
    n = len(a)
    buckets = (n + 3) // 4
    home = (b % np.uint64(buckets)).astype(np.int64)
    displace, taken = np.zeros(buckets, np.int64), np.zeros(n, bool)
    prints, found = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    order = np.argsort(home, kind="stable")
    starts = np.searchsorted(home[order], np.arange(buckets + 1))
    sizes = np.diff(starts)
    free = None
    for bucket in np.argsort(-sizes, kind="stable"):
        if not sizes[bucket]:
            break
        keys = order[starts[bucket]:starts[bucket + 1]]
        if len(keys) == 1:  # all that follow have one key as well: each names its slot
            if free is None:
                free = iter(np.flatnonzero(~taken))
            slots = np.array([next(free)])
            displace[bucket] = -slots[0] - 1
        else:
            first = 1
            while True:
                tries = np.arange(first, first + 64)
                s = _slot(a[keys][None, :], tries[:, None], np.uint64(n)).astype(np.int64)
                ranked = np.sort(s, axis=1)
                good = ~taken[s].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    displace[bucket], slots = tries[k], s[k]
                    break
                first += 64
        taken[slots] = True
        prints[slots], found[slots] = _print(a[keys], b[keys]), counts[keys]
    return displace, prints, found


def build_index(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """The shards' arrays for lines in at least ``min_docs`` documents, as a written table; their number."""
    frequent = cut(counts.where(F.col("n") >= min_docs))
    shards = max(1, -(-frequent.count() // KEYS_PER_SHARD))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["a"].to_numpy().view(np.uint64), rows["b"].to_numpy().view(np.uint64)
        displace, prints, found = build_shard(a, b, rows["n"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "n": [len(a)], "displace": [displace.tobytes()],
                             "prints": [prints.tobytes()], "counts": [found.tobytes()]})

    dealt = frequent.withColumn("shard", F.pmod(F.col("a"), F.lit(shards)))
    return cut(dealt.groupBy("shard").applyInPandas(build, INDEX_TYPE)), shards


class Probe:
    """Several shards' arrays end to end; ``counts(a, b)`` looks keys up, 0 for lines that are not indexed."""

    def __init__(self, rows: list, shards: int):
        self.shards = shards
        self.n, self.at, self.bucket_at = (np.zeros(shards, np.int64) for _ in range(3))
        self.buckets = np.zeros(shards, np.int64)
        displace, prints, counts = [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)]
        slots = cells = 1
        for r in rows:
            d = np.frombuffer(r["displace"], np.int64)
            s = r["shard"]
            self.n[s], self.buckets[s], self.at[s], self.bucket_at[s] = r["n"], len(d), slots, cells
            displace.append(d)
            prints.append(np.frombuffer(r["prints"], np.uint64))
            counts.append(np.frombuffer(r["counts"], np.int64))
            slots, cells = slots + r["n"], cells + len(d)
        self.displace, self.prints, self.found = map(np.concatenate, (displace, prints, counts))

    def counts(self, h: np.ndarray) -> np.ndarray:
        a, b = h[:, 0], h[:, 1]
        shard = np.mod(a.view(np.int64), self.shards)
        n = self.n[shard]
        some = n > 0
        bucket = (b % np.maximum(self.buckets[shard], 1).astype(np.uint64)).astype(np.int64) + self.bucket_at[shard]
        d = self.displace[np.where(some, bucket, 0)]
        hashed = _slot(a, np.maximum(d, 0), np.maximum(n, 1).astype(np.uint64)).astype(np.int64)
        slot = np.where(some, np.where(d < 0, -d - 1, hashed) + self.at[shard], 0)
        return np.where(some & (self.prints[slot] == _print(a, b)), self.found[slot], 0)


def _kept(text: bytes | None, drop: np.ndarray) -> bytes:
    lines = (text or b"").split(b"\n")
    return b"\n".join([x for x, gone in zip(lines, drop, strict=True) if not gone]) if drop.any() else b"\n".join(lines)


def _schema(row: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("row", row), T.StructField("text", T.StringType()),
                         T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def drop_frequent_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
                        index_mb: float = INDEX_MB) -> DataFrame:
    """``row`` (struct of the other columns), ``text`` without its frequent lines, ``n_lines``, ``n_dropped``."""
    spark = docs.sparkSession
    index, shards = build_index(line_counts(docs, text_col, min_chars), min_docs)
    rows = docs.select(payload(docs, text_col), F.col(f"`{text_col}`").alias("text"))
    mb = index.agg(F.sum(F.length("displace") + F.length("prints") + F.length("counts"))).first()[0] or 0
    if mb > index_mb * 1e6:
        return _by_shuffled_probe(rows, index, shards, min_docs, min_chars)
    arrays = spark.sparkContext.broadcast(index.collect())  # at most index_mb
    made: list[Probe] = []

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Probe(arrays.value, shards))
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            keys = [line_keys(t) for t in texts]
            flat = [k for ks in keys for k in ks]
            long = np.fromiter((_long_enough(k, min_chars) for k in flat), bool, len(flat))
            drop = (made[0].counts(hashes(flat)) >= min_docs) & long
            ends = np.cumsum([len(k) for k in keys])
            parts = np.split(drop, ends[:-1])
            kept = pa.array([_kept(t, d) for t, d in zip(texts, parts, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), kept, pa.array([len(d) for d in parts], pa.int64()),
                 pa.array([int(d.sum()) for d in parts], pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    return rows.mapInArrow(strip, _schema(rows.schema["row"].dataType))


def _by_shuffled_probe(rows: DataFrame, index: DataFrame, shards: int, min_docs: int, min_chars: int) -> DataFrame:
    """The way for an index of any size: line hashes travel to the shards, hits travel back.

    A document is named by a 128-bit hash of its text, so equal texts ask once for all.
    """
    keyed = rows.withColumn("d1", F.xxhash64("text")).withColumn("d2", F.xxhash64(F.lit(1), "text"))
    texts = keyed.dropDuplicates(["d1", "d2"]).select("d1", "d2", "text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d1, d2, text in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1),
                                                            batch.column(2).cast(pa.large_binary()))), strict=True):
                at: dict[bytes, list[int]] = {}
                for i, key in enumerate(line_keys(text)):
                    if _long_enough(key, min_chars):
                        at.setdefault(key, []).append(i)
                h = hashes(list(at)).view("<i8")
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d1] * k, pa.int64()), pa.array([d2] * k, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]),
                     pa.array(list(at.values()), pa.list_(pa.int32()))], ["d1", "d2", "a", "b", "at"])

    asked = texts.mapInArrow(ask, "d1 long, d2 long, a long, b long, at array<int>")
    asked = asked.withColumn("shard", F.pmod(F.col("a"), F.lit(shards))).withColumn("salt", F.pmod(F.col("d1"), F.lit(SALTS)))
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    def probe(asks: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if arrays.empty or asks.empty:
            return asks.iloc[:0][["d1", "d2", "at"]]
        seen = Probe([r._asdict() | {"shard": 0} for r in arrays.itertuples(index=False)], 1)
        return asks[seen.counts(asks[["a", "b"]].to_numpy().view(np.uint64)) >= min_docs][["d1", "d2", "at"]]

    hits = (asked.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt"))
            .applyInPandas(probe, "d1 long, d2 long, at array<int>")
            .groupBy("d1", "d2").agg(F.flatten(F.collect_list("at")).alias("gone")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return (keyed.join(hits, ["d1", "d2"], "left")
            .select("row", lines.alias("lines"), gone.alias("gone"))
            .select("row", F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)), "\n").alias("text"),
                    F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped")))
