"""Mixing sources to target weights by subset-sum budget fitting.

Sizes and counts: documents are counted by (source, exact size). Weights share the budget; a target stops at
``max_repeats`` times its source's size, and what is above is reshared by weight until none is (the level at
which that settles is found in closed form over the sources' table). A target of q whole sources and a rest
takes every document q times; the rest is fitted by counts per size: every size first gives its share
of all but the last few longest documents' words (cumulatively rounded), and a bounded-knapsack dynamic
program over the counts that are left closes the remaining budget. Which documents of a size are taken is
decided by a seeded hash: those up to a threshold that is the exact order statistic of the group, found
by counting hash buckets, so that no (source, size) group is ever sorted by one task.

A source's histogram has at most sqrt(2 * its words) rows (its sizes are distinct). The program runs over twice the words of
the longest document or more, however long that is: a bit and four bytes for each word.

Cases: null text has size 0; documents of size 0 are taken as their source's whole passes are; null
sources form the last source; identical rows share one hash and are taken together or not at all; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import cut, payload, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
#: Words left to the dynamic program: those of so many of the longest documents, up to DP_WORDS, but two of them at least.
DP_DOCS, DP_WORDS = 64, 10_000_000
_FIT = "source_no int, size long, base int, take long, docs long"


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def knapsack(budget: int, sizes: Sequence[int], counts: Sequence[int]) -> dict[int, int]:
    """Counts per size, within ``counts``, whose sizes sum to the largest reachable total up to ``budget``.

    Bounded-knapsack dynamic programming over a bit set of reachable sums, in units of the sizes' common divisor; counts are
    split into powers of two. Of every sum the step that first reached it is kept, which leads back to the counts.
    """
    unit = math.gcd(*map(int, sizes)) or 1
    budget //= unit
    reach, steps, full = 1, [], (1 << (budget + 1)) - 1
    first = np.zeros(budget + 1, np.int32)
    for size, count in zip(sizes, counts, strict=True):
        step = int(size) // unit
        count = min(int(count), budget // step) if step else 0
        part = 1
        while count > 0 and not reach >> budget & 1:
            k = min(part, count)
            new = reach << (step * k) & full & ~reach
            if new:
                steps.append((int(size), k))
                low = (new & -new).bit_length() - 1 & ~7  # bits from the first byte that has any
                found = np.frombuffer((new >> low).to_bytes(((new >> low).bit_length() + 7) // 8, "little"), np.uint8)
                first[low + np.flatnonzero(np.unpackbits(found, bitorder="little"))] = len(steps)
                reach |= new
            count, part = count - k, part * 2
    at, taken = reach.bit_length() - 1, {}
    while at:  # a sum's remainder was reached by an earlier step
        size, k = steps[first[at] - 1]
        taken[size] = taken.get(size, 0) + k
        at -= size // unit * k
    return taken


def fit(budget: int, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Documents to take of each size (ascending, positive), so that the words come to ``budget`` as nearly as can be.

    Every size first gives its share of all but the last words. Rounding shares cumulatively errs by less than the
    longest document, so at least that many words are left to the program, whatever the sizes are.
    """
    total = int((sizes * counts).sum())
    if total <= 0 or budget <= 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.copy()
    longest = int(sizes.max())
    open_ = min(budget, max(2 * longest, min(DP_WORDS, DP_DOCS * longest)))  # left to the dynamic program
    shares = np.floor(np.cumsum(counts) * ((budget - open_) / total) + 0.5).astype(np.int64)
    take = np.clip(np.diff(shares, prepend=0), 0, counts)
    rest = budget - int((sizes * take).sum())
    left = counts - take
    some = np.flatnonzero((sizes <= rest) & (left > 0))
    some = some[np.random.default_rng(len(sizes)).permutation(len(some))]  # no length is preferred; a fixed order
    for size, k in (knapsack(rest, sizes[some].tolist(), left[some].tolist()) if len(some) else {}).items():
        take[np.searchsorted(sizes, size)] += k
    return take


def targets(sizes: DataFrame, weights: Sequence[float], budget_ratio: float, max_repeats: float) -> DataFrame:
    """Of (source, source_size): source_no by code point with null last, and the target. One row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    no = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_no"), F.lit(len(weights))) + 1)
    s = (sizes.withColumn("source_no", no.cast("int")).withColumn("w", weight)
         .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))))
    order = [F.col("cap") / F.col("w"), F.col("source_no")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(budget_ratio))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    s = s.withColumn("level", level).withColumn("settles", F.col("level") <= F.col("cap") / F.col("w"))
    level = F.min(F.when(F.col("settles"), F.struct(order[0].alias("o"), F.col("source_no").alias("s"), "level"))).over(everything)
    return s.withColumn("at", level["level"]).select(
        "source", "source_no", "source_size",
        F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def fit_counts(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """(source_no, size, base, take, docs): whole passes over a source, and documents of the size taken once more."""

    def one_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        total, target = int((sizes * counts).sum()), float(rows["target"].iloc[0])
        base = int(target // total) if total else 0
        some = sizes > 0
        take = np.zeros(len(rows), np.int64)
        take[some] = fit(round(target - base * total), sizes[some], counts[some])
        return pd.DataFrame({"source_no": rows["source_no"], "size": sizes, "base": base, "take": take, "docs": counts})

    joined = histogram.join(goals, histogram["source"].eqNullSafe(goals["source"]))
    return joined.select("source_no", "size", "n", "target").groupBy("source_no").applyInPandas(one_source, _FIT)


def thresholds(points: DataFrame, counts: DataFrame) -> DataFrame:
    """(source_no, size, base, upto): documents of the group whose hash is at most ``upto`` are taken once more.

    Groups are dealt by hash into sqrt(n) buckets; bucket counts name the bucket with the take-th row, and only
    that bucket's rows are ordered. Equal hashes stand or fall together, never above the count.
    """
    open_ = counts.where((F.col("take") > 0) & (F.col("take") < F.col("docs")))
    wide = F.ceil(F.lit(float(1 << 63)) / F.ceil(F.sqrt("docs")))
    # dealt anew by bucket: the join leaves a hot (source, size) on one key
    dealt = (points.join(open_, ["source_no", "size"])
             .select("source_no", "size", "h", "take", F.floor(F.col("h") / wide).alias("bucket"))
             .repartition("source_no", "size", "bucket"))
    n = dealt.groupBy("source_no", "size", "bucket").agg(F.count(F.lit(1)).alias("n"), F.first("take").alias("take"))
    upto = Window.partitionBy("source_no", "size").orderBy("bucket")
    n = n.withColumn("until", F.sum("n").over(upto))
    edge = (n.where((F.col("until") >= F.col("take")) & (F.col("until") - F.col("n") < F.col("take")))
            .select("source_no", "size", "bucket", (F.col("take") - F.col("until") + F.col("n")).alias("need")))
    le = F.count(F.lit(1)).over(Window.partitionBy("source_no", "size", "bucket").orderBy("h"))
    at = (dealt.join(edge, ["source_no", "size", "bucket"]).withColumn("le", le)
          .withColumn("low", F.lit(-1).cast("long"))
          .groupBy("source_no", "size", "bucket")
          .agg(F.max(F.when(F.col("le") <= F.col("need"), F.col("h"))).alias("inside"), F.min("h").alias("first"))
          .select("source_no", "size", F.coalesce("inside", F.col("first") - 1).alias("edge")))
    everyone = F.lit((1 << 63) - 1)
    return (counts.join(at, ["source_no", "size"], "left")
            .select("source_no", "size", "base",
                    F.when(F.col("take") <= 0, F.lit(-1).cast("long")).when(F.col("take") >= F.col("docs"), everyone)
                    .otherwise(F.coalesce("edge", F.lit(-1).cast("long"))).alias("upto")))


def mix(docs: DataFrame, size: Column, key: Sequence[str], source_col: str = "source", weights: Sequence[float] = (5, 2, 1),
        budget_ratio: float = 1.5, max_repeats: float = 2, seed: int = 17) -> DataFrame:
    """``row`` (all columns of docs), ``size``, ``source_size``, ``target``, ``copies`` (times the mix takes it).

    ``size`` is an expression over docs; ``key`` names the columns whose seeded hash decides among equal sizes.
    """
    h = unit_hash(*[F.col(f"`{c}`") for c in key], seed=seed)
    rows = docs.select(payload(docs), F.col(f"`{source_col}`").alias("source"), size.alias("size"), h.alias("h"))
    points = cut(rows.select("source", "size", "h"))
    histogram = cut(points.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    goals = cut(targets(sizes, weights, budget_ratio, max_repeats))
    names = goals.select(F.col("source").alias("name"), "source_no")
    numbered = points.join(names, F.col("source").eqNullSafe(F.col("name"))).select("source_no", "size", "h")
    taken = thresholds(numbered, cut(fit_counts(histogram, goals)))
    plan = cut(taken.join(goals, "source_no").select(
        F.col("source").alias("of"), F.col("size").alias("words"), "source_size", "target", "base", "upto"))
    copies = F.col("base") + (F.col("h") <= F.col("upto")).cast("int")
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("words")))
            .select("row", "size", "source_size", "target", copies.cast("int").alias("copies")))
