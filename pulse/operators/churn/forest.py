"""Random forest for training rows that one task can hold: whole trees are grown side by side, one task each.

The method is that of Spark ML's ``RandomForestClassifier``, whose fit passes over the rows, with a job of its own, for
every level: Poisson bootstrap, at most ``MAX_BINS`` bins a feature between weighted quantiles, ceil(sqrt(features)) features drawn for
each node, the split of greatest weighted Gini gain, leaves that are pure, gain nothing or lie at the depth limit, sibling leaves
merged that name the same class, and votes that are the weighted class shares of leaves. Bins come from all rows (Spark ML takes 10,000 of them). Draws depend on
seed, tree and the order of the rows alone, not on who grows the tree.

A tree is packed breadth first: of each node the feature (-1: a leaf) and the last bin that goes left, and of each leaf the share of
class 1. Children of the i-th inner node are nodes 2i + 1 and 2i + 2. Packed trees are rows of a Parquet table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.session import new_folder, ship, written

MAX_BINS = 32
#: Histogram cells of a group of nodes, and rows that walk a tree together.
CELLS, WALK_ROWS = 1 << 19, 1 << 14
#: Least gain of a split: below is rounding.
LEAST_GAIN = 1e-14
#: Tasks for each core: trees differ in size.
TASKS = 4
#: Packed bytes of the trees that the driver and each task hold together in scoring.
WAVE_BYTES = 48 << 20


def cut_points(values: np.ndarray, weights: np.ndarray, most: int = MAX_BINS - 1) -> list[float]:
    """Cuts between distinct ascending ``values``: all of them, or those nearest to quantiles of the weight (as Spark ML's)."""
    with np.errstate(invalid="ignore"):
        middle = values[:-1] + (values[1:] - values[:-1]) / 2
    middle = np.where(np.isfinite(middle), middle, values[:-1])
    if len(middle) <= most:
        return middle.tolist()
    sums = np.cumsum(weights)
    stride, cuts = sums[-1] / (most + 1), []
    target = stride
    for i, (before, after) in enumerate(zip(sums[:-1].tolist(), sums[1:].tolist(), strict=True)):
        if abs(before - target) < abs(after - target):
            cuts.append(float(middle[i]))
            target += stride
    return cuts[:most]


def cuts_of(rows: DataFrame, features: int) -> list[list[float]]:
    """The cuts of each feature over ``rows`` (_x: array<double>, weight)."""
    def one(key: tuple, of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values(["value", "weight"])
        values, at = np.unique(of["value"].to_numpy(), return_inverse=True)
        found = cut_points(values, np.bincount(at, of["weight"].to_numpy() * of["n"].to_numpy()))
        return pd.DataFrame({"feature": [key[0]], "cuts": [found]})

    cells = rows.select("weight", F.posexplode("_x").alias("feature", "value"))
    counted = cells.groupBy("feature", "value", "weight").agg(F.count(F.lit(1)).alias("n"))
    found = {r["feature"]: list(r["cuts"]) for r in counted.groupBy("feature").applyInPandas(one, "feature int, cuts array<double>").collect()}
    return [found[f] for f in range(features)]


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bins (rows x features) of values: the cuts below each."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(np.asarray(c, float), x[:, f])
    return out


def with_bins(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """``rows`` with their features (_x: array<double>) replaced by the bins, one byte each."""
    names = [c for c in rows.columns if c != "_x"]
    schema = rows.select(*names, F.lit(b"").alias("_bins")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, wide = b.num_rows, len(cuts)
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(n, wide)
            ends = np.arange(0, n * wide + 1, wide, dtype=np.int32)[: n + 1]
            bins = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(binned(x, cuts).tobytes())])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), bins], [*names, "_bins"])

    return rows.select(*names, "_x").mapInArrow(run, schema)


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int, tree: int, max_depth: int,
         n_bins: int = MAX_BINS, subset: int | None = None) -> bytes:
    """One packed tree over rows of ``bins`` with ``label`` 0 or 1 and ``weight``; ``subset``: features drawn for a node."""
    rng = np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, tree])
    n, wide = bins.shape
    k = subset or int(np.ceil(np.sqrt(wide)))
    drawn = rng.poisson(1.0, n)
    if not drawn.any():
        drawn[:] = 1
    flat, at = bins.reshape(-1), np.flatnonzero(drawn)
    y, w = label[at].astype(np.int64), (weight * drawn)[at]
    at = at * wide
    sizes = np.array([len(at)])
    levels = []
    for depth in range(max_depth + 1):
        node = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(node * 2 + y, w, 2 * len(sizes)).reshape(-1, 2)
        feature, last = np.full(len(sizes), -1, np.int16), np.zeros(len(sizes), np.uint8)
        open_ = np.flatnonzero((total > 0).all(axis=1)) if depth < max_depth else np.empty(0, int)
        if len(open_):
            # rows of open nodes only; nodes in groups of bounded histograms
            rows = np.repeat((total > 0).all(axis=1), sizes)
            at, y, w = at[rows], y[rows], w[rows]
            held = sizes[open_]
            drawn_f = np.argpartition(rng.random((len(open_), wide)), k - 1, axis=1)[:, :k] if k < wide else np.tile(np.arange(wide), (len(open_), 1))
            starts = np.concatenate([[0], np.cumsum(held)])
            step = max(1, CELLS // (k * 2 * n_bins))
            for a in range(0, len(open_), step):
                b = min(a + step, len(open_))
                f, last_bin = _splits(flat, at[starts[a]:starts[b]], y[starts[a]:starts[b]], w[starts[a]:starts[b]], held[a:b], drawn_f[a:b], n_bins)
                feature[open_[a:b]], last[open_[a:b]] = f, last_bin
        levels.append((feature, last, total))
        leaf = feature < 0
        if leaf.all():
            break
        # rows of nodes that are split, each node's left ones first
        rows = np.repeat(~leaf[open_], held)
        at, y, w, held, split = at[rows], y[rows], w[rows], held[~leaf[open_]], open_[~leaf[open_]]
        node = np.repeat(np.arange(len(held)), held)
        left = flat[at + feature[split][node]] <= last[split][node]
        before = np.cumsum(left) - left
        first = np.cumsum(held) - held
        lefts = np.add.reduceat(left, first, dtype=np.int64)
        rank = before - before[first][node]
        place = np.where(left, first[node] + rank, (first + lefts)[node] + np.arange(len(at)) - first[node] - rank)
        order = np.empty(len(at), np.int64)
        order[place] = np.arange(len(at))
        at, y, w = at[order], y[order], w[order]
        sizes = np.column_stack([lefts, held - lefts]).reshape(-1)
    return pack(*map(np.concatenate, zip(*_merged(levels), strict=True)))


def _merged(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each level's features, last left bins and leaves' shares; a node whose two leaves name the same class is a leaf."""
    splits = [np.flatnonzero(feature >= 0) for feature, _, _ in levels]
    for (feature, _, _), split, (below, _, total) in reversed(list(zip(levels, splits, levels[1:], strict=False))):
        named = (total[:, 1] > total[:, 0]).reshape(-1, 2)
        feature[split[(below < 0).reshape(-1, 2).all(axis=1) & (named[:, 0] == named[:, 1])]] = -1
    kept = np.ones(1, bool)
    for (feature, last, total), split in zip(levels, splits, strict=True):
        leaf = total[kept & (feature < 0)]
        yield feature[kept], last[kept], leaf[:, 1] / leaf.sum(axis=1)
        kept = np.repeat((kept & (feature >= 0))[split], 2)


def _splits(flat: np.ndarray, at: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, drawn: np.ndarray,
            n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The best split of each node among its drawn features: feature (-1: none gains) and last bin of the left side."""
    m, k = drawn.shape
    node = np.repeat(np.arange(m), held)
    cell = node * (k * 2 * n_bins) + y * n_bins
    cells = np.concatenate([cell + j * 2 * n_bins + flat[at + drawn[:, j][node]] for j in range(k)])
    hist = np.bincount(cells, np.tile(w, k), m * k * 2 * n_bins)
    left = np.cumsum(hist.reshape(m, k, 2, n_bins), axis=3)
    all_ = left[:, :, :, -1:]
    right = (all_ - left)[:, :, :, :-1]
    left = left[:, :, :, :-1]
    wl, wr, whole = left.sum(axis=2), right.sum(axis=2), all_.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left ** 2).sum(axis=2) / wl + (right ** 2).sum(axis=2) / wr - (all_ ** 2).sum(axis=2) / whole
    gain = np.where((wl > 0) & (wr > 0), gain / whole, 0).reshape(m, -1)
    best = gain.argmax(axis=1)
    nodes = np.arange(m)
    feature = np.where(gain[nodes, best] > LEAST_GAIN, drawn[nodes, best // (n_bins - 1)], -1)
    return feature.astype(np.int16), (best % (n_bins - 1)).astype(np.uint8)


def pack(feature: np.ndarray, last: np.ndarray, share: np.ndarray) -> bytes:
    parts = [zlib.compress(x.tobytes(), 1) for x in (feature.astype("<i2"), last.astype("u1"), share.astype("<f8"))]
    return struct.pack("<3I", *map(len, parts)) + b"".join(parts)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and last left bin of each node, share of class 1 of each leaf."""
    out, at = [], 12
    for n, kind in zip(struct.unpack_from("<3I", data), ("<i2", "u1", "<f8"), strict=True):
        out.append(np.frombuffer(zlib.decompress(data[at:at + n]), kind))
        at += n
    return tuple(out)


def votes(bins: np.ndarray, trees: list[bytes]) -> np.ndarray:
    """For each row the sum of the trees' shares of class 1, in the order of the trees."""
    n, wide = bins.shape
    flat, out = bins.reshape(-1), np.zeros(n)
    for data in trees:
        feature, last, share = unpack(data)
        inner = feature >= 0
        left = 2 * np.cumsum(inner) - 1
        # a leaf leads to itself: its feature is the first, and every bin goes left
        left = np.where(inner, left, np.arange(len(feature)))
        value = np.zeros(len(feature))
        value[~inner] = share
        feature, last = np.where(inner, feature, 0).astype(np.int64), np.where(inner, last, 255).astype(np.uint8)
        for a in range(0, n, WALK_ROWS):
            rows = np.arange(a, min(a + WALK_ROWS, n))
            base, node, at = rows * wide, np.zeros(len(rows), np.int64), rows
            while len(at):
                for _ in range(4):
                    node = left[node] + (flat[base + feature[node]] > last[node])
                going = inner[node]
                done = ~going
                out[at[done]] += value[node[done]]
                at, base, node = at[going], base[going], node[going]
    return out


def grown(rows: DataFrame, label_col: str, features: int, num_trees: int, max_depth: int, seed: int) -> tuple[str, list[list[float]]]:
    """The folder of a table of packed trees (tree, size, data), and the features' cuts.

    ``rows`` (_x: array<double>, the label 0 or 1, weight) are dealt and sorted by their values. Their bins, labels and weights pass
    through the driver to every executor once: the caller bounds them.
    """
    spark = rows.sparkSession
    ship(spark)
    cuts = cuts_of(rows, features)
    placed = with_bins(rows.select(F.monotonically_increasing_id().alias("place"), "_x",
                                   F.col(label_col).cast("byte").alias("label"), "weight"), cuts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                parts = [b.column("place")[0].as_py(), b"".join(b.column("_bins").to_pylist()),
                         b.column("label").to_numpy().tobytes(), b.column("weight").to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([p]) for p in parts], ["place", "bins", "label", "weight"])

    blocks = sorted(placed.mapInArrow(packed, "place long, bins binary, label binary, weight binary").collect(), key=lambda r: r["place"])
    matrix, label, weight = (b"".join(bytes(r[c]) for r in blocks) for c in ("bins", "label", "weight"))
    held = spark.sparkContext.broadcast((matrix, label, weight))
    n_bins = max(2, max(map(len, cuts)) + 1)

    def grow_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, label, weight = held.value
        label, weight = np.frombuffer(label, np.uint8), np.frombuffer(weight, "<f8")
        matrix = np.frombuffer(matrix, np.uint8).reshape(len(label), features)
        for b in batches:
            for tree in b.column("id").to_pylist():
                data = grow(matrix, label, weight, seed, tree, max_depth, n_bins)
                yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["tree", "size", "data"])

    folder, tasks = new_folder(spark), min(num_trees, TASKS * spark.sparkContext.defaultParallelism)
    try:
        spark.range(0, num_trees, 1, tasks).mapInArrow(grow_some, "tree long, size long, data binary").write.parquet(folder)
    finally:
        held.destroy()
    return folder, cuts


def waves(trees: DataFrame) -> list[tuple[int, int]]:
    """First and last tree of the groups that are held together."""
    out, total = [], 0
    for r in sorted(trees.select("tree", "size").collect()):
        if not out or total + r["size"] > WAVE_BYTES:
            out.append((r["tree"], r["tree"]))
            total = 0
        out[-1] = (out[-1][0], r["tree"])
        total += r["size"]
    return out


def wave_votes(base: DataFrame, trees: DataFrame, wave: tuple[int, int], parts: int) -> tuple[DataFrame, int]:
    """What the trees of a wave give to every row of ``base`` (_row, _bins), written, and the number of trees."""
    spark = base.sparkSession
    ship(spark)
    some = [bytes(r["data"]) for r in sorted(trees.where(F.col("tree").between(*wave)).collect(), key=lambda r: r["tree"])]
    held = spark.sparkContext.broadcast(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            bins = np.frombuffer(b"".join(b.column("_bins").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(votes(bins, held.value))], ["_row", "_votes"])

    try:
        return written(base.select("_row", "_bins").repartition(parts).mapInArrow(run, "_row long, _votes double")), len(some)
    finally:
        held.destroy()


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 8 * WALK_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows or a batch more: a tree is unpacked once for each."""
    some, n = [], 0
    for b in batches:
        if b.num_rows:
            some.append(b)
            n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, n = [], 0
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()
