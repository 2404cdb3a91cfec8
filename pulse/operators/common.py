"""Building blocks shared by the KPI operators.

Scale notes
-----------
* Sessions are reduced to distinct ``(user_id, day)`` pairs *before* they meet the
  users table.  A user with a third of all sessions then contributes at most one row
  per day to the join, and every distinct count becomes a plain count.
* Order metrics are additive (counts, decimal sums), so every order aggregate runs
  with a map-side partial phase; hot join keys are left to AQE skew-join splitting.
* No side is hinted for broadcast unless its size is bounded by the parameters
  (calendar days, selected value lists, one-row aggregates).  Dimension tables
  (users, vendors) are left to AQE, which converts a join to broadcast only after
  measuring the actual shuffle size.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import CANCELLED, COMPLETED, money
from pulse.functions.dates import day, day_range, in_days
from pulse.functions.filters import FilterSpec, where
from pulse.sources.marts import Marts


def users_f(m: Marts, spec: FilterSpec) -> DataFrame:
    """Users after the city/channel/device lists."""
    return where(m.users, spec.user_predicate())


def signups(m: Marts, spec: FilterSpec, d1: date | None = None, d2: date | None = None) -> DataFrame:
    """Users (filtered) whose signup day is in [d1, d2]; adds ``day``."""
    d1, d2 = d1 or spec.date_from, d2 or spec.date_to
    return users_f(m, spec).filter(in_days("created_at", d1, d2)).withColumn("day", day("created_at"))


def active_pairs(m: Marts, spec: FilterSpec, d1: date, d2: date, keep_cols: tuple[str, ...] = (),
                 activity_col: str = "session_date") -> DataFrame:
    """Distinct (user_id, day) with a session in [d1, d2] of users passing the user filters.

    The inner join with users drops sessions of unknown users (as the source does).
    ``keep_cols`` adds user attributes (e.g. a breakdown dimension).
    """
    pairs = (day_range(m.sessions, activity_col, d1, d2)
             .select("user_id", day(activity_col).alias("day")).distinct())
    u = users_f(m, spec).select("user_id", *keep_cols)
    return pairs.join(u, "user_id")


def order_base(m: Marts, spec: FilterSpec, vendor_join: str = "inner", status_filter: bool = True) -> DataFrame:
    """Orders in range joined to users (inner) and vendors, with all list filters.

    ``vendor_join='inner'`` is the KPI/sales shape (orders without a vendor vanish);
    ``'left'`` keeps them (unless a category list is set).  Columns: order_id,
    user_id, vendor_id, day, order_status, order_total, commission, city,
    acquisition_channel, device, category, v_city, rating.

    The fact side is joined first and aggregated after: the aggregate's partial
    (map-side) phase collapses rows before its shuffle, and a hot user or vendor
    key in a sort-merge join is split by AQE's skew-join handling.
    """
    o = (day_range(m.orders, "order_date", spec.date_from, spec.date_to)
         .select("order_id", "user_id", "vendor_id", day("order_date").alias("day"), "order_status",
                 money("order_total").alias("order_total"), money("commission").alias("commission")))
    u = users_f(m, spec).select("user_id", "city", "acquisition_channel", "device")
    v = m.vendors.select("vendor_id", F.col("category").cast("string").alias("category"),
                         F.col("city").alias("v_city"), "rating")
    out = o.join(u, "user_id").join(v, "vendor_id", vendor_join)
    return where(out, spec.order_predicate(status="order_status" if status_filter else None))


def order_metrics() -> list:
    """orders_total/completed/cancelled, gmv and commission (completed only) over order rows.

    Money sums stay decimal until the final cast to double.
    """
    st = F.col("order_status")
    zero = F.lit(0).cast("decimal(28,2)")
    return [
        F.count(F.lit(1)).cast("bigint").alias("orders_total"),
        F.count_if(st == COMPLETED).cast("bigint").alias("orders_completed"),
        F.count_if(st == CANCELLED).cast("bigint").alias("orders_cancelled"),
        F.coalesce(F.sum(F.when(st == COMPLETED, F.col("order_total"))), zero).cast("double").alias("gmv"),
        F.coalesce(F.sum(F.when(st == COMPLETED, F.col("commission"))), zero).cast("double").alias("commission"),
    ]


def first_order_in_range(m: Marts, d1: date, d2: date, users: DataFrame | None = None) -> DataFrame:
    """Per user, the first order with day in [d1, d2] (earliest order_date, then smallest order_id).

    ``min(struct(...))`` is aggregated per user first, with a map-side partial aggregate below
    the first exchange: a user with a third of all orders sends one row from each task.  Only then
    ``users`` (user_id), when given, restricts the result to the users that need it.
    Columns: user_id, fo_order_id, fo_vendor_id, fo_status.
    """
    first = (day_range(m.orders, "order_date", d1, d2).groupBy("user_id")
             .agg(F.min(F.struct("order_date", "order_id", "vendor_id", "order_status")).alias("fo")))
    if users is not None:
        first = first.join(users.select("user_id"), "user_id", "left_semi")
    return first.select("user_id", F.col("fo.order_id").alias("fo_order_id"),
                        F.col("fo.vendor_id").alias("fo_vendor_id"), F.col("fo.order_status").alias("fo_status"))


def attach(scalars: DataFrame):
    """``df.transform(attach(s))``: add the columns of ``s`` to every row of ``df``.

    ``s`` is a global aggregate, exactly one row by construction.  It is broadcast,
    and each input row yields exactly one output row: a scalar attachment, never a
    pairing of two tables.
    """
    one = F.broadcast(scalars)
    return lambda df: df.crossJoin(one)
