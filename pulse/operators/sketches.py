"""Mergeable sketches of users and scores: small per-day state whose union answers any range, with stated error bounds.

* Distinct users by HLL sketches. Standard error of an estimate: ``HLL_ERROR`` / sqrt(2^lg_k).
* Users common to two windows or dimensions by theta sketches with intersection. With k = 2^lg_k kept hashes, the relative
  standard error against the *union* is about 1 / sqrt(k); unions that fit in k are exact.
* Distributions by KLL sketches: a quantile's true rank is within ``kll_rank_error(k)`` of the asked one with 99 % confidence.

Everywhere the exact number can be had as well (bitmaps, semi-joins, order statistics); the sketches are for what has to be
kept small and merged often.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import TOTAL, label
from pulse.functions.filters import FilterSpec
from pulse.operators.common import active_pairs
from pulse.sources.marts import Marts

DIMS = {"city": "city", "channel": "acquisition_channel", "device": "device"}
HLL_LG_K, HLL_ERROR, THETA_LG_K, KLL_K = 12, 1.04, 12, 200


def hll_error(lg_k: int = HLL_LG_K) -> float:
    """Relative standard error of a distinct count."""
    return HLL_ERROR / 2 ** (lg_k / 2)


def kll_rank_error(k: int = KLL_K) -> float:
    """Rank error of a quantile with 99 % confidence, as a share of all values (a fit published for these sketches)."""
    return 2.296 / k ** 0.9021


def _by_dim(m: Marts, spec: FilterSpec, d1: date, d2: date) -> DataFrame:
    pairs = active_pairs(m, spec, d1, d2, tuple(DIMS.values()))
    lines = [F.struct(F.lit("total").alias("dim"), F.lit(TOTAL).alias("series"))]
    lines += [F.struct(F.lit(d).alias("dim"), label(c).alias("series")) for d, c in DIMS.items()]
    return pairs.select("day", "user_id", F.explode(F.array(*lines)).alias("s")).select("day", "user_id", "s.dim", "s.series")


def day_user_sketches(m: Marts, spec: FilterSpec, d1: date, d2: date, lg_k: int = HLL_LG_K) -> DataFrame:
    """(day, dim, series, users): an HLL sketch of each day's users."""
    return _by_dim(m, spec, d1, d2).groupBy("day", "dim", "series").agg(F.hll_sketch_agg("user_id", lg_k).alias("users"))


def estimated_users(sketches: DataFrame, d1: date, d2: date) -> DataFrame:
    """(dim, series, estimate): distinct users of [d1, d2] from the day sketches alone."""
    some = sketches.where(F.col("day").between(F.lit(d1), F.lit(d2)))
    return some.groupBy("dim", "series").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("estimate"))


def window_sketches(m: Marts, spec: FilterSpec, windows: Sequence[tuple[str, date, date]], lg_k: int = THETA_LG_K) -> DataFrame:
    """(window, dim, series, users): a theta sketch of the users of each window, from one read of the sessions."""
    rows = _by_dim(m, spec, min(w[1] for w in windows), max(w[2] for w in windows))
    inside = F.filter(F.array(*[F.when(F.col("day").between(F.lit(a), F.lit(b)), F.lit(n)) for n, a, b in windows]), lambda w: w.isNotNull())
    rows = rows.withColumn("window", F.explode(inside))
    return rows.groupBy("window", "dim", "series").agg(F.theta_sketch_agg("user_id", lg_k).alias("users"))


def overlaps(sketches: DataFrame, one: str, two: str) -> DataFrame:
    """(dim, series, users_one, users_two, both): estimated users of two windows and of both."""
    a = sketches.where(F.col("window") == one).select("dim", "series", F.col("users").alias("a"))
    b = sketches.where(F.col("window") == two).select("dim", "series", F.col("users").alias("b"))
    met = a.join(b, ["dim", "series"])
    return met.select("dim", "series", *[F.theta_sketch_estimate(x).alias(n) for x, n in (
        (F.col("a"), "users_one"), (F.col("b"), "users_two"), (F.theta_intersection("a", "b"), "both"))])


def exact_overlaps(m: Marts, spec: FilterSpec, one: tuple[date, date], two: tuple[date, date]) -> DataFrame:
    """(dim, series, both): the same, exactly: users with a session in both windows, reduced per user first."""
    rows = _by_dim(m, spec, min(one[0], two[0]), max(one[1], two[1]))
    users = rows.groupBy("user_id", "dim", "series").agg(*[
        F.max(F.col("day").between(F.lit(a), F.lit(b)).cast("int")).alias(n) for n, (a, b) in (("in_one", one), ("in_two", two))])
    return users.groupBy("dim", "series").agg(F.sum(F.col("in_one") * F.col("in_two")).cast("bigint").alias("both"))


def score_sketches(scored: DataFrame, by: str, value: str, k: int = KLL_K) -> DataFrame:
    """(by, scores): a KLL sketch of each group's values; sketches of the same k merge by ``kll_merge_agg_double``."""
    return scored.where(F.col(value).isNotNull()).groupBy(by).agg(F.kll_sketch_agg_double(value, k).alias("scores"))


def quantiles(sketches: DataFrame, by: Sequence[str], wanted: Sequence[float]) -> DataFrame:
    """(by, q, value) for each wanted share, from the sketches of each group merged."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("scores").alias("scores"))
    each = [F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("scores", F.lit(float(q))).alias("value")) for q in wanted]
    return merged.select(*by, F.explode(F.array(*each)).alias("e")).select(*by, "e.q", "e.value")


def exact_ranks(scored: DataFrame, found: DataFrame, by: str, value: str) -> DataFrame:
    """(by, q, value, n, below, up_to): how many of the group's values lie below each found value, and up to it.

    ``found`` is a list of a few quantiles for each group (broadcast): one pass of conditional counts over the scores.
    """
    marks = found.groupBy(by).agg(F.collect_list(F.struct("q", "value")).alias("marks"))
    rows = scored.where(F.col(value).isNotNull()).select(by, F.col(value).alias("_x")).join(F.broadcast(marks), by)
    rows = rows.select(by, "_x", F.explode("marks").alias("m"))
    return rows.groupBy(by, F.col("m.q").alias("q"), F.col("m.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_x") < F.col("m.value")).alias("below"),
        F.count_if(F.col("_x") <= F.col("m.value")).alias("up_to"))
