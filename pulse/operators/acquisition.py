"""Acquisition analytics: signups, period comparison, dense daily series, breakdowns, shares.

Signups are users whose ``created_at`` day falls in the range, after the user
filters.  Output columns match the source application's result frames.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.columns import NO_PURCHASE, TOTAL, bigint, delta_pct, ratio, round_half_even
from pulse.functions.dates import calendar, day, mmdd_label, with_days
from pulse.functions.filters import USER_DIM_COLUMN, Dim, FilterSpec
from pulse.operators.common import attach, first_order_in_range, signups, users_f
from pulse.sources.marts import Marts


def users_base_vs_new(m: Marts, spec: FilterSpec) -> DataFrame:
    """One row: users before d1, users created in [d1, d2], all users (user filters only). One scan."""
    d = day("created_at")
    return users_f(m, spec).agg(
        F.count_if(d < F.lit(spec.date_from)).cast("bigint").alias("base_before"),
        F.count_if(d.between(F.lit(spec.date_from), F.lit(spec.date_to))).cast("bigint").alias("new_in_range"),
        F.count(F.lit(1)).cast("bigint").alias("total_all"),
    )


def new_users_vs_prev(m: Marts, spec: FilterSpec) -> DataFrame:
    """Signups now vs the previous window of equal length, in one scan of users."""
    pd1, pd2 = spec.previous_window()
    d = day("created_at")
    agg = users_f(m, spec).agg(
        F.count_if(d < F.lit(spec.date_from)).cast("bigint").alias("users_before"),
        F.count_if(d.between(F.lit(spec.date_from), F.lit(spec.date_to))).cast("bigint").alias("new_users"),
        F.count_if(d.between(F.lit(pd1), F.lit(pd2))).cast("bigint").alias("new_users_prev"),
    )
    total = F.col("users_before") + F.col("new_users")
    return agg.select(
        "users_before", "new_users", "new_users_prev",
        total.alias("total_considered"),
        ratio("new_users", total).alias("pct_new"),
        F.lit(pd1).alias("prev_d1"), F.lit(pd2).alias("prev_d2"),
        (F.col("new_users") - F.col("new_users_prev")).alias("delta_abs"),
        delta_pct("new_users", "new_users_prev").alias("delta_pct"),
        (F.col("new_users").cast("double") / F.lit(float(spec.days))).alias("avg_new_per_day"),
    )


def _daily_signups(m: Marts, spec: FilterSpec, d1: date, d2: date) -> DataFrame:
    # Grouped by day inside [d1, d2]: at most (d2 - d1 + 1) rows, safe to broadcast.
    return signups(m, spec, d1, d2).groupBy("day").agg(F.count(F.lit(1)).alias("new_users"))


def new_users_daily(m: Marts, spec: FilterSpec, start: date | None = None, end: date | None = None) -> DataFrame:
    """Dense daily signups over [start, end] (defaults: the spec's range); missing days are 0."""
    d1, d2 = start or spec.date_from, end or spec.date_to
    daily = _daily_signups(m, spec, d1, d2)
    return (calendar(m.spark, d1, d2).join(F.broadcast(daily), "day", "left")
            .select("day", bigint(F.coalesce("new_users", F.lit(0))).alias("new_users")))


def new_users_daily_extended(m: Marts, spec: FilterSpec, start: date, end: date) -> DataFrame:
    return new_users_daily(m, spec, start, end)


def new_users_cumulative(m: Marts, spec: FilterSpec) -> DataFrame:
    """Dense daily signups plus ``users_cum`` = users before d1 + running sum (window over days only)."""
    dense = new_users_daily(m, spec)
    base = users_f(m, spec).agg(F.count_if(day("created_at") < F.lit(spec.date_from)).alias("users_before"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (dense.transform(attach(base))
            .select("day", "new_users",
                    bigint(F.col("users_before") + F.sum("new_users").over(w)).alias("users_cum")))


def new_users_delta(m: Marts, spec: FilterSpec) -> DataFrame:
    """Day-over-day change of signups; the first day keeps its own value."""
    dense = new_users_daily(m, spec)
    w = Window.orderBy("day")
    return dense.select("day", "new_users",
                        F.coalesce(F.col("new_users") - F.lag("new_users").over(w), F.col("new_users"))
                        .alias("delta_new"))


def _series_list(values, with_total: bool) -> list[str]:
    out = list(values)
    return out + [TOTAL] if with_total else out


def _values_frame(m: Marts, values: list[str]) -> DataFrame:
    """A frame of the selected values (bounded by the parameter list)."""
    return m.spark.createDataFrame([(v,) for v in values], "series string")


def _total_only(m: Marts, spec: FilterSpec) -> DataFrame:
    return new_users_daily(m, spec).select("day", F.lit(TOTAL).alias("series"), F.col("new_users").alias("value"))


def new_users_by_dim(m: Marts, spec: FilterSpec, total_mode: str = "selected") -> DataFrame:
    """Dense (day, series, value) signups per selected value of a user dimension, plus Total.

    ``total_mode='selected'`` (the live behaviour): Total = sum of the selected series.
    ``total_mode='true'``: Total = all signups after the filters.
    Another dimension, or no selected values, gives the Total series only.
    """
    dim, vals = spec.series_values()
    if not dim.is_user_dim or not vals:
        return _total_only(m, spec)
    col = USER_DIM_COLUMN[dim]
    s = signups(m, spec).select("day", F.col(col).cast("string").alias("series"))
    by_dim = (s.filter(F.col("series").isin(list(vals)))
              .groupBy("day", "series").agg(F.count(F.lit(1)).alias("v")))
    grid = with_days(_values_frame(m, list(vals)), spec.date_from, spec.date_to)
    # by_dim has at most days x len(vals) rows: bounded by the parameters.
    detail = (grid.join(F.broadcast(by_dim), ["day", "series"], "left")
              .select("day", "series", bigint(F.coalesce("v", F.lit(0))).alias("value")))
    if total_mode == "selected":
        total = detail.groupBy("day").agg(F.sum("value").cast("bigint").alias("value")) \
                      .select("day", F.lit(TOTAL).alias("series"), "value")
    else:
        total = _total_only(m, spec)
    out = detail.unionByName(total)
    if not spec.show_total_series:
        out = out.filter(F.col("series") != TOTAL)
    return out


def new_users_by_dim_selected_total(m: Marts, spec: FilterSpec) -> DataFrame:
    return new_users_by_dim(m, spec, "selected")


def new_users_by_dim_true_total(m: Marts, spec: FilterSpec) -> DataFrame:
    return new_users_by_dim(m, spec, "true")


def first_order_tags(m: Marts, spec: FilterSpec, users: DataFrame | None = None) -> DataFrame:
    """(user_id, fo_category, fo_status) of each user's first order in range.

    The vendor is left-joined, so a first order without a known vendor has a NULL
    category (reported as 'Sin compra').
    """
    fo = first_order_in_range(m, spec.date_from, spec.date_to, users)
    v = m.vendors.select(F.col("vendor_id").alias("fo_vendor_id"), F.col("category").alias("fo_category"))
    return fo.join(v, "fo_vendor_id", "left").select(
        "user_id", F.col("fo_category").cast("string").alias("fo_category"),
        F.col("fo_status").cast("string").alias("fo_status"))


def first_order_series(dim: Dim):
    return F.col("fo_category") if dim is Dim.CATEGORY else F.col("fo_status")


def new_users_by_first_order_dim(m: Marts, spec: FilterSpec) -> DataFrame:
    """Signups per day by the category/status of their first order in range; Total = all signups."""
    dim, vals = spec.series_values()
    if not dim.is_order_dim or not vals:
        return _total_only(m, spec)
    su = signups(m, spec).select("user_id", "day")
    fo = first_order_tags(m, spec, su)
    tagged = su.join(fo, "user_id", "left").select(
        "user_id", "day", F.coalesce(first_order_series(dim), F.lit(NO_PURCHASE)).alias("series"))
    by_dim = (tagged.filter(F.col("series").isin(list(vals)))
              .groupBy("day", "series").agg(F.countDistinct("user_id").alias("v")))
    total = tagged.groupBy("day").agg(F.countDistinct("user_id").alias("t"))
    grid = with_days(_values_frame(m, _series_list(vals, True)), spec.date_from, spec.date_to)
    out = (grid.join(F.broadcast(by_dim), ["day", "series"], "left")
           .join(F.broadcast(total), "day", "left")
           .select("day", "series",
                   bigint(F.when(F.col("series") == TOTAL, F.coalesce("t", F.lit(0)))
                          .otherwise(F.coalesce("v", F.lit(0)))).alias("value")))
    if not spec.show_total_series:
        out = out.filter(F.col("series") != TOTAL)
    return out


def new_users_cum_by_series(m: Marts, spec: FilterSpec) -> DataFrame:
    """Running total per series inside the range (window partitioned by series over days only)."""
    s = new_users_by_dim_selected_total(m, spec)
    w = Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.withColumn("cum_in_range", F.sum("value").over(w).cast("bigint"))


def _signup_counts(m: Marts, spec: FilterSpec, dim: Dim) -> DataFrame:
    col = USER_DIM_COLUMN[dim]
    return (signups(m, spec).groupBy(F.col(col).cast("string").alias("series"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("new_users")))


def new_users_share(m: Marts, spec: FilterSpec) -> DataFrame:
    """Per value of the breakdown dimension: new users and share of all new users.

    The total is a one-row aggregate joined back (broadcast of one row), not a
    global window, so no single task receives every group.
    """
    dim = spec.series_dim
    if not dim.is_user_dim:
        return m.spark.createDataFrame([], "series string, new_users bigint, share double")
    agg = _signup_counts(m, spec, dim)
    tot = agg.agg(F.sum("new_users").alias("total_new"))
    return agg.transform(attach(tot)).select(
        "series", "new_users", ratio("new_users", "total_new").alias("share"))


def _top_series(share: DataFrame, n: int) -> DataFrame:
    # Ties on the count are broken by name so that the cut is deterministic.
    return share.orderBy(F.desc("new_users"), F.asc_nulls_last("series")).limit(n)


def new_users_samples(m: Marts, spec: FilterSpec, top_n: int = 5, per_series: int = 5) -> DataFrame:
    """For the top-5 values by new users: the first 5 users by signup time, joined with ', '.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before the
    shuffle, so each map task forwards at most k rows per series; the final
    per-series list is bounded by k.
    """
    dim = spec.series_dim
    if not dim.is_user_dim:
        return m.spark.createDataFrame([], "series string, sample_users string")
    col = USER_DIM_COLUMN[dim]
    top = _top_series(new_users_share(m, spec), top_n).select("series")
    base = (signups(m, spec).select(F.col(col).cast("string").alias("series"), "user_id", "created_at")
            .join(F.broadcast(top), "series", "left_semi"))
    w = Window.partitionBy("series").orderBy("created_at", "user_id")
    ranked = base.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_series)
    return ranked.groupBy("series").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col("user_id").cast("string").alias("u")))),
                        lambda x: x["u"]), ", ").alias("sample_users"))


def new_users_top10(m: Marts, spec: FilterSpec, n: int = 10) -> DataFrame:
    """Top values by new users (desc), ties by name."""
    share = new_users_share(m, spec)
    return (share.select(F.col("series").cast("string").alias("dim"), F.col("new_users").alias("total_usuarios"))
            .orderBy(F.desc("total_usuarios"), F.asc_nulls_last("dim")).limit(n))


def new_users_share_summary(m: Marts, spec: FilterSpec) -> DataFrame:
    """series, share_pct (1 decimal, half-to-even), total_usuarios."""
    share = new_users_share(m, spec)
    return share.select(
        F.col("series").cast("string").alias("series"),
        round_half_even(F.col("share") * 100, 1).alias("share_pct"),
        F.col("new_users").alias("total_usuarios"))


def period_bars(daily: DataFrame, period_days: int, selected_index: int, value_col: str = "value") -> DataFrame:
    """Equal-length period bars from a (day, value) frame: the source's bar-chart data step.

    The first period starts at the frame's *first day present* (one-row aggregate),
    period_idx = floor((day - start) / period), values summed; label 'mm-dd→mm-dd';
    ``selected`` marks ``selected_index``.  When empty bins were dropped upstream the
    index is relative to the first surviving day, so the highlight can move (kept).
    """
    start = daily.agg(F.min("day").alias("_start"))
    idx = F.floor(F.datediff(F.col("day"), F.col("_start")) / F.lit(int(period_days))).cast("bigint")
    agg = (daily.transform(attach(start))
           .groupBy(idx.alias("period_idx"), "_start").agg(F.sum(value_col).cast("bigint").alias("value")))
    s0 = F.date_add(F.col("_start"), (F.col("period_idx") * period_days).cast("int"))
    return agg.select("period_idx", mmdd_label(s0, period_days).alias("label"), "value",
                      (F.col("period_idx") == selected_index).alias("selected"))


def new_users_period_bins(m: Marts, spec: FilterSpec, n_prev_periods: int = 6) -> DataFrame:
    """Signups summed per equal-length period: the selected one and ``n_prev_periods`` before it."""
    period = spec.days
    start_all = spec.date_from - timedelta(days=period * n_prev_periods)
    daily = new_users_daily(m, spec, start_all, spec.date_to)
    return period_bars(daily, period, n_prev_periods, "new_users")
