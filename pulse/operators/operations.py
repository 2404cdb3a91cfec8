"""Operations analytics: order counts by day and by dimension, rates, shares, long form.

Operations queries never filter by status, left-join vendors (orders without a
vendor stay unless a category list is set) and resolve their columns from the
input schemas (see ``pulse.sources.resolver``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import CANCELLED, COMPLETED, TOTAL, UNKNOWN, ratio, round_half_even
from pulse.functions.filters import Dim, FilterSpec
from pulse.operators.common import attach
from pulse.sources.marts import Marts
from pulse.sources.resolver import resolve_orders

_EMPTY_TS = "day date, orders_total bigint, orders_completed bigint, orders_cancelled bigint"
_EMPTY_SHARE = "series string, orders_total bigint, orders_completed bigint, orders_cancelled bigint"


def _counts(has_status: bool) -> list:
    if has_status:
        return [F.count(F.lit(1)).cast("bigint").alias("orders_total"),
                F.count_if(F.col("status") == COMPLETED).cast("bigint").alias("orders_completed"),
                F.count_if(F.col("status") == CANCELLED).cast("bigint").alias("orders_cancelled")]
    return [F.count(F.lit(1)).cast("bigint").alias("orders_total"),
            F.lit(0).cast("bigint").alias("orders_completed"), F.lit(0).cast("bigint").alias("orders_cancelled")]


def ops_timeseries(m: Marts, spec: FilterSpec) -> DataFrame:
    """Per day with orders: orders_total, orders_completed, orders_cancelled (no status filter)."""
    r = resolve_orders(m.users, m.orders, m.vendors, spec)
    if not r.ok:
        return m.spark.createDataFrame([], _EMPTY_TS)
    return r.frame.groupBy("day").agg(*_counts(r.has_status))


def ops_timeseries_rates(m: Marts, spec: FilterSpec) -> DataFrame:
    return (ops_timeseries(m, spec)
            .withColumn("cancel_rate", ratio("orders_cancelled", "orders_total"))
            .withColumn("fulfillment_rate", ratio("orders_completed", "orders_total")))


def ops_share_by_dim(m: Marts, spec: FilterSpec, dim: Dim | None = None) -> DataFrame:
    """Order counts per value of a dimension ('Total' when none; NULL or missing column -> 'UNKNOWN')."""
    r = resolve_orders(m.users, m.orders, m.vendors, spec)
    if not r.ok:
        return m.spark.createDataFrame([], _EMPTY_SHARE)
    dim = Dim(dim or spec.series_dim)
    if dim is Dim.NONE:
        key = F.lit(TOTAL)
    else:
        col, present = {Dim.CITY: ("city", r.has_city), Dim.CHANNEL: ("channel", r.has_channel),
                        Dim.DEVICE: ("device", r.has_device), Dim.CATEGORY: ("category", r.has_vendor_category),
                        Dim.STATUS: ("status", r.has_status)}[dim]
        key = F.col(col).cast("string") if present else F.lit(None).cast("string")
    return (r.frame.groupBy(F.coalesce(key, F.lit(UNKNOWN)).alias("series")).agg(*_counts(r.has_status)))


METRIC_COLUMNS = {"total": "orders_total", "completed": "orders_completed", "cancelled": "orders_cancelled"}


def ops_share_metric(m: Marts, spec: FilterSpec, metric: str = "total", dim: Dim | None = None) -> DataFrame:
    """(series, value, share) for one metric; no dimension -> one 'Total' row, share 1.0 (0.0 if empty)."""
    col = METRIC_COLUMNS[metric]
    dim = Dim(dim or spec.series_dim)
    by = ops_share_by_dim(m, spec, dim).select("series", F.col(col).alias("value"))
    tot = by.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("_total"))
    if dim is Dim.NONE:
        return tot.select(F.lit(TOTAL).alias("series"), F.col("_total").cast("bigint").alias("value"),
                          F.when(F.col("_total") > 0, 1.0).otherwise(0.0).alias("share"))
    return (by.transform(attach(tot))
            .select("series", "value", ratio("value", "_total").alias("share")))


def ops_share_summary(m: Marts, spec: FilterSpec, metric: str = "total", dim: Dim | None = None) -> DataFrame:
    """series, total, share_pct (1 decimal, half-to-even)."""
    return ops_share_metric(m, spec, metric, dim).select(
        "series", F.col("value").alias("total"), round_half_even(F.col("share") * 100, 1).alias("share_pct"))


# Fixed legend labels of the operations chart, in display order.
OPS_METRIC_LABELS = [("Órdenes", "orders_total"), ("Atendidas", "orders_completed"),
                     ("Canceladas", "orders_cancelled"), ("Cancel rate", "cancel_rate"),
                     ("Fulfillment", "fulfillment_rate")]


def metrics_long(m: Marts, spec: FilterSpec) -> DataFrame:
    """Long form (day, metric, value) of the daily operations metrics (``unpivot``, no join).

    'Órdenes' is included only when the Total series is shown.
    """
    wide = ops_timeseries_rates(m, spec)
    labels = [(lab, c) for lab, c in OPS_METRIC_LABELS if spec.show_total_series or c != "orders_total"]
    wide = wide.select("day", *[F.col(c).cast("double").alias(lab) for lab, c in labels])
    return wide.unpivot(["day"], [lab for lab, _ in labels], "metric", "value")
