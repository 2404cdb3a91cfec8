"""Activation and engagement: DAU, MAU, stickiness, 7-day activation, active users.

An active user is a user with at least one session on a day.  Every distinct count
starts from distinct ``(user_id, day)`` pairs (see ``common.active_pairs``), so the
per-day counts are plain counts and a very active user costs one row per day.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import NO_PURCHASE, TOTAL, UNKNOWN, bigint, delta_pct, label, ratio, round_half_even
from pulse.functions.dates import bin_index, bin_starts, calendar, day, day_range, month_bounds, with_days
from pulse.functions.filters import USER_DIM_COLUMN, Dim, FilterSpec, where
from pulse.operators.acquisition import first_order_series, first_order_tags
from pulse.operators.common import active_pairs, attach, signups, users_f
from pulse.sources.marts import Marts


def dau_daily(m: Marts, spec: FilterSpec, d1: date | None = None, d2: date | None = None,
              activity_col: str = "session_date") -> DataFrame:
    """(day, dau) for days that have sessions (sparse)."""
    d1, d2 = d1 or spec.date_from, d2 or spec.date_to
    return (active_pairs(m, spec, d1, d2, activity_col=activity_col)
            .groupBy("day").agg(F.count(F.lit(1)).cast("bigint").alias("dau")))


def dau_daily_extended(m: Marts, spec: FilterSpec, start: date | None = None, end: date | None = None) -> DataFrame:
    """Dense DAU over [start, end]; days without sessions are 0."""
    d1, d2 = start or spec.date_from, end or spec.date_to
    daily = dau_daily(m, spec, d1, d2)  # at most one row per day of the range
    return (calendar(m.spark, d1, d2).join(F.broadcast(daily), "day", "left")
            .select("day", bigint(F.coalesce("dau", F.lit(0))).alias("dau")))


def _dau_7d_avg(m: Marts, spec: FilterSpec) -> DataFrame:
    # Latest 7 days *having sessions* (top-7 is TakeOrderedAndProject: 7 rows per task).
    last7 = dau_daily(m, spec).orderBy(F.desc("day")).limit(7)
    return last7.agg(F.coalesce(F.avg("dau"), F.lit(0.0)).alias("dau_7d_avg"))


def dau_7d_avg(m: Marts, spec: FilterSpec) -> DataFrame:
    return _dau_7d_avg(m, spec)


def mau(m: Marts, spec: FilterSpec) -> DataFrame:
    """Distinct active users in the whole calendar month of date_to (also days after date_to).

    Written as a day range so the scan prunes by the date predicate.
    """
    start, nxt = month_bounds(spec.date_to)
    users = (day_range(m.sessions, "session_date", start, nxt - timedelta(days=1))
             .select("user_id").distinct()
             .join(users_f(m, spec).select("user_id"), "user_id"))
    return users.agg(F.count(F.lit(1)).cast("bigint").alias("mau"))


def stickiness(m: Marts, spec: FilterSpec) -> DataFrame:
    """dau_7d_avg / mau (0 when mau is 0)."""
    return (_dau_7d_avg(m, spec).transform(attach(mau(m, spec)))
            .select("dau_7d_avg", "mau", ratio("dau_7d_avg", "mau").alias("stickiness")))


def activation_7d(m: Marts, spec: FilterSpec, with_count: bool = False) -> DataFrame:
    """Share of range signups whose first-ever order day (any status) is <= signup day + 7.

    No lower bound: an order before signup counts; no signups gives 0.0.
    Since signup day <= date_to, an order later than date_to + 7 can never decide the
    test, so only orders up to that day are read.  They are reduced to one day per user before
    they meet the signups (a hot user sends one row from each task).  The whole past still counts, so
    materialised marts store ``users.first_order_day`` and the order scan disappears.
    """
    hit = F.col("first_order_day").isNotNull() & (F.col("first_order_day") <= F.date_add("signup_day", 7))
    rate = F.coalesce(F.avg(F.when(hit, 1.0).otherwise(0.0)), F.lit(0.0)).alias("activation_7d")
    out = [F.count(F.lit(1)).cast("bigint").alias("new_users"), rate] if with_count else [rate]
    if "first_order_day" in m.users.columns:
        # materialised marts keep each user's first order day: no order scan at all
        return (signups(m, spec).select(F.col("day").alias("signup_day"), "first_order_day").agg(*out))
    su = signups(m, spec).select("user_id", F.col("day").alias("signup_day"))
    horizon = spec.date_to + timedelta(days=7)
    first = (m.orders.filter(day("order_date") <= F.lit(horizon)).groupBy("user_id").agg(F.min(day("order_date")).alias("first_order_day")))
    return su.join(first, "user_id", "left").agg(*out)


def signups_and_activation(m: Marts, spec: FilterSpec) -> DataFrame:
    """One row (new_users, activation_7d) from one pass over the range's signups."""
    return activation_7d(m, spec, with_count=True)


def active_users_vs_prev(m: Marts, spec: FilterSpec) -> DataFrame:
    """Active users in range vs the previous window of equal length, plus total users and average DAU.

    One session scan over [prev_d1, d2]; distinct users per window from per-user flags.
    """
    pd1, pd2 = spec.previous_window()
    pairs = active_pairs(m, spec, pd1, spec.date_to)
    cur = F.col("day") >= F.lit(spec.date_from)
    per_user = pairs.groupBy("user_id").agg(F.max(cur.cast("int")).alias("cur"), F.max((~cur).cast("int")).alias("prev"))
    active = per_user.agg(F.coalesce(F.sum("cur"), F.lit(0)).cast("bigint").alias("active_users"),
                          F.coalesce(F.sum("prev"), F.lit(0)).cast("bigint").alias("active_users_prev"))
    avg_dau = (pairs.filter(cur).groupBy("day").agg(F.count(F.lit(1)).alias("dau"))
               .agg(F.coalesce(F.avg("dau"), F.lit(0.0)).alias("avg_dau")))
    total = users_f(m, spec).agg(F.count(F.lit(1)).cast("bigint").alias("total_users_all"))
    out = total.transform(attach(active)).transform(attach(avg_dau))
    return out.select(
        "total_users_all", "active_users", "active_users_prev",
        ratio("active_users", "total_users_all").alias("share_active"),
        "avg_dau",
        F.lit(pd1).alias("prev_d1"), F.lit(pd2).alias("prev_d2"),
        (F.col("active_users") - F.col("active_users_prev")).alias("delta_abs"),
        delta_pct("active_users", "active_users_prev").alias("delta_pct"),
        F.greatest(F.col("total_users_all") - F.col("active_users"), F.lit(0)).alias("inactive_users"),
    )


def active_users_by_bins(m: Marts, spec: FilterSpec, start: date, end: date, period_days: int,
                         keep_empty: bool | None = None) -> DataFrame:
    """Distinct active users per fixed-length bin [bin_start, bin_start + period - 1], bins from start to end.

    The source states this as a range join (session day BETWEEN bin bounds); here the
    bin is computed arithmetically, so it is an aggregation with no join at all.
    Source quirks kept: the last bin may extend past ``end``; with user filters the
    empty bins disappear (``keep_empty`` defaults to "no user filter").  Without user
    filters, sessions of users absent from the users table are counted too.
    """
    starts = bin_starts(start, end, period_days)
    if not starts:
        return m.spark.createDataFrame([], "day date, value bigint")
    last_end = starts[-1] + timedelta(days=period_days - 1)
    s = (day_range(m.sessions, "session_date", start, last_end)
         .select("user_id", bin_index(day("session_date"), start, period_days).alias("bin")).distinct())
    pred = spec.user_predicate()
    if pred is not None:
        s = s.join(users_f(m, spec).select("user_id"), "user_id", "left_semi")
    per_bin = (s.filter(F.col("user_id").isNotNull())
               .groupBy("bin").agg(F.count(F.lit(1)).alias("value")))
    bins = m.spark.range(len(starts)).select(F.col("id").alias("bin"))
    if keep_empty is None:
        keep_empty = pred is None
    out = bins.join(F.broadcast(per_bin), "bin", "left" if keep_empty else "inner")
    return out.select(F.date_add(F.lit(start), (F.col("bin") * period_days).cast("int")).alias("day"),
                      bigint(F.coalesce("value", F.lit(0))).alias("value"))


def _dim_pairs(m: Marts, spec: FilterSpec, dim: Dim, activity_col: str = "session_date") -> DataFrame:
    col = USER_DIM_COLUMN[dim]
    return (active_pairs(m, spec, spec.date_from, spec.date_to, keep_cols=(col,), activity_col=activity_col)
            .select("user_id", "day", label(col, UNKNOWN).alias("series")))


def _dense_total(m: Marts, spec: FilterSpec, activity_col: str = "session_date") -> DataFrame:
    daily = dau_daily(m, spec, activity_col=activity_col)
    return (calendar(m.spark, spec.date_from, spec.date_to).join(F.broadcast(daily), "day", "left")
            .select("day", F.lit(TOTAL).alias("series"), bigint(F.coalesce("dau", F.lit(0))).alias("value")))


def _densify(m: Marts, spec: FilterSpec, daily: DataFrame) -> DataFrame:
    """Every observed series x every day of the range, missing cells 0.

    The day axis is generated next to each series (explode), not joined.
    """
    series = daily.select("series").distinct()
    grid = with_days(series, spec.date_from, spec.date_to)
    return (grid.join(daily, ["day", "series"], "left")
            .select("day", "series", bigint(F.coalesce("value", F.lit(0))).alias("value")))


def dau_by_dim(m: Marts, spec: FilterSpec) -> DataFrame:
    """Dense (day, series, value): a true-distinct Total plus every observed value of the dimension.

    NULL dimension values are reported as 'UNKNOWN'.  Non-user dimensions: Total only.
    """
    total = _dense_total(m, spec)
    dim = spec.series_dim
    if not dim.is_user_dim:
        return total
    daily = _dim_pairs(m, spec, dim).groupBy("day", "series").agg(F.count(F.lit(1)).alias("value"))
    return total.unionByName(_densify(m, spec, daily))


def dau_by_dim_summed_total(m: Marts, spec: FilterSpec, activity_col: str = "session_date") -> DataFrame:
    """Older variant: Total = sum of the per-series counts; activity date is a parameter."""
    dim = spec.series_dim
    if not dim.is_user_dim:
        return _dense_total(m, spec, activity_col)
    by_dim = _dim_pairs(m, spec, dim, activity_col).groupBy("day", "series").agg(F.count(F.lit(1)).alias("value"))
    total = by_dim.groupBy("day").agg(F.sum("value").alias("value")).select("day", F.lit(TOTAL).alias("series"), "value")
    return _densify(m, spec, by_dim.unionByName(total))


def _active_users(m: Marts, spec: FilterSpec) -> DataFrame:
    return (day_range(m.sessions, "session_date", spec.date_from, spec.date_to)
            .select("user_id").distinct())


def active_users_by_user_dim(m: Marts, spec: FilterSpec, dim: Dim | None = None) -> DataFrame:
    """(dim, active_users) by a user dimension; NULL -> 'UNKNOWN'."""
    dim = Dim(dim or spec.series_dim)
    if not dim.is_user_dim:
        return m.spark.createDataFrame([], "dim string, active_users bigint")
    col = USER_DIM_COLUMN[dim]
    u = users_f(m, spec).select("user_id", label(col, UNKNOWN).alias("dim"))
    return (_active_users(m, spec).join(u, "user_id")
            .groupBy("dim").agg(F.count(F.lit(1)).cast("bigint").alias("active_users")))


def active_users_by_first_order_dim(m: Marts, spec: FilterSpec, dim: Dim | None = None) -> DataFrame:
    """(dim, active_users) by category/status of each active user's first order in range.

    Category and status lists apply to that first order, so a non-empty list (the
    default) removes the users without one ('Sin compra').
    """
    dim = Dim(dim or spec.series_dim)
    if not dim.is_order_dim:
        return m.spark.createDataFrame([], "dim string, active_users bigint")
    active = _active_users(m, spec).join(users_f(m, spec).select("user_id"), "user_id")
    tagged = active.join(first_order_tags(m, spec, active), "user_id", "left")
    tagged = where(tagged, spec.order_predicate("fo_category", "fo_status"))
    return (tagged.select("user_id", F.coalesce(first_order_series(dim), F.lit(NO_PURCHASE)).alias("dim"))
            .groupBy("dim").agg(F.countDistinct("user_id").cast("bigint").alias("active_users")))


def active_users_share_top8(m: Marts, spec: FilterSpec, dim: Dim | None = None, top_n: int = 8) -> DataFrame:
    """Total row (sum of all values) + the largest values, cut at ``top_n`` rows *including* Total.

    share_pct = 100 * value / (sum of the kept non-Total rows), 1 decimal; Total shows 100.
    """
    dim = Dim(dim or spec.series_dim)
    by_dim = (active_users_by_user_dim(m, spec, dim) if dim.is_user_dim
              else active_users_by_first_order_dim(m, spec, dim))
    keep = top_n - 1 if spec.show_total_series else top_n
    kept = by_dim.orderBy(F.desc("active_users"), F.asc_nulls_last("dim")).limit(keep)
    denom = kept.agg(F.sum("active_users").alias("denom"))
    detail = (kept.transform(attach(denom))
              .select("dim", "active_users",
                      round_half_even(F.lit(100.0) * F.col("active_users") /
                                      F.when(F.col("denom") > 0, F.col("denom").cast("double")).otherwise(1.0), 1)
                      .alias("share_pct")))
    if not spec.show_total_series:
        return detail
    total = by_dim.agg(F.coalesce(F.sum("active_users"), F.lit(0)).cast("bigint").alias("active_users")) \
                  .select(F.lit(TOTAL).alias("dim"), "active_users", F.lit(100.0).alias("share_pct"))
    return total.unionByName(detail)
