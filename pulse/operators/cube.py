"""Detail and totals in one pass: every combination of city, channel and device with all its totals.

The source runs one statement for the detail and another for the total and appends them. Grouping sets give both
from one scan: a row is expanded to the sets it belongs to and aggregated with a map-side part. Null
dimension values are named before, so "Total" is never mixed up with a missing value. Distinct users stay exact because
rows are reduced to one per user, or per user and day, before the cube: each user is in one cell of every set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import TOTAL, label
from pulse.functions.filters import FilterSpec
from pulse.operators.common import active_pairs, order_base, order_metrics, signups
from pulse.sources.marts import Marts

DIMS = {"city": "city", "channel": "acquisition_channel", "device": "device"}


def with_totals(rows: DataFrame, measures: list[Column], keys: tuple[str, ...] = (), sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """``measures`` by ``keys`` and by every subset of city, channel, device (or by ``sets`` of them); left-out dimensions read 'Total'."""
    named = rows.select("*", *[label(c).alias(f"_{d}") for d, c in DIMS.items()])
    dims = [F.col(f"_{d}") for d in DIMS]
    if sets is None:
        sets = [tuple(d for i, d in enumerate(DIMS) if bits >> i & 1) for bits in range(1 << len(DIMS))]
    grouped = named.groupingSets([[*(F.col(k) for k in keys), *(F.col(f"_{d}") for d in s)] for s in sets], *keys, *dims)
    out = grouped.agg(*measures)
    return out.select(*keys, *[F.coalesce(f"_{d}", F.lit(TOTAL)).alias(d) for d in DIMS],
                      *[c for c in out.columns if c not in keys and c not in {f"_{d}" for d in DIMS}])


def orders_cube(m: Marts, spec: FilterSpec) -> DataFrame:
    """(city, channel, device, orders_total, orders_completed, orders_cancelled, gmv, commission) with all totals."""
    return with_totals(order_base(m, spec), order_metrics())


def new_users_cube(m: Marts, spec: FilterSpec) -> DataFrame:
    """(city, channel, device, new_users): signups of the range with all totals."""
    return with_totals(signups(m, spec), [F.count(F.lit(1)).alias("new_users")])


def active_users_cube(m: Marts, spec: FilterSpec) -> DataFrame:
    """(city, channel, device, active_users, user_days): distinct users of the range, and their active days, with all totals."""
    pairs = active_pairs(m, spec, spec.date_from, spec.date_to, tuple(DIMS.values()))
    users = pairs.groupBy("user_id", *DIMS.values()).agg(F.count(F.lit(1)).alias("days"))
    return with_totals(users, [F.count(F.lit(1)).alias("active_users"), F.sum("days").alias("user_days")])


def dau_with_totals(m: Marts, spec: FilterSpec) -> DataFrame:
    """(day, city, channel, device, dau): each dimension by itself and the total, a day at a time."""
    pairs = active_pairs(m, spec, spec.date_from, spec.date_to, tuple(DIMS.values()))
    return with_totals(pairs, [F.count(F.lit(1)).alias("dau")], ("day",), [(), *((d,) for d in DIMS)])
