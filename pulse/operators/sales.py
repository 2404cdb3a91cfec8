"""Sales analytics: the KPI summary, order KPIs, daily sales, top-K tables, breakdowns.

KPI and sales queries inner-join vendors (orders without a vendor vanish) and honour
the status list; the top-10-by-dimension query resolves its columns, left-joins
vendors and counts completed orders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import COMPLETED, UNKNOWN, ratio
from pulse.functions.filters import Dim, FilterSpec
from pulse.operators import activation as act
from pulse.operators.common import attach, order_base, order_metrics, signups
from pulse.sources.marts import Marts
from pulse.sources.resolver import resolve_orders


def _orders_agg(m: Marts, spec: FilterSpec) -> DataFrame:
    return order_base(m, spec).agg(*order_metrics())


def orders_kpis(m: Marts, spec: FilterSpec) -> DataFrame:
    """One row: orders total/completed/cancelled, GMV, commission, AOV, cancel rate."""
    return _orders_agg(m, spec).select(
        "orders_total", "orders_completed", "orders_cancelled", "gmv", "commission",
        ratio("gmv", "orders_completed").alias("aov"),
        ratio("orders_cancelled", "orders_total").alias("cancel_rate"))


def kpi_summary(m: Marts, spec: FilterSpec) -> DataFrame:
    """The flagship one-row summary (12 fields), assembled from one-row aggregates.

    Every part reads its fact with its own pushed-down days: sessions of the range and of the
    month, orders of the range, and the orders that decide activation; signups are counted in
    the activation pass. The one-row results are attached to each other (broadcast of one row each).
    """
    row = (act.dau_7d_avg(m, spec).transform(attach(act.mau(m, spec)))
           .transform(attach(act.signups_and_activation(m, spec))).transform(attach(_orders_agg(m, spec))))
    return row.select(
        "dau_7d_avg", F.col("mau").cast("double").alias("mau"),
        ratio("dau_7d_avg", "mau").alias("stickiness"),
        "new_users", "activation_7d",
        "orders_total", "orders_completed", "orders_cancelled",
        ratio("orders_cancelled", "orders_total").alias("cancel_rate"),
        "gmv", ratio("gmv", "orders_completed").alias("aov"), "commission")


def sales_timeseries(m: Marts, spec: FilterSpec) -> DataFrame:
    """Per day with orders: gmv, orders_total, orders_completed, orders_cancelled (sparse)."""
    return (order_base(m, spec).groupBy("day").agg(*order_metrics())
            .select("day", "gmv", "orders_total", "orders_completed", "orders_cancelled"))


def sales_timeseries_rates(m: Marts, spec: FilterSpec) -> DataFrame:
    return sales_timeseries(m, spec).withColumn("cancel_rate", ratio("orders_cancelled", "orders_total"))


def _gmv_orders_all_status():
    # GMV counts completed orders; ``orders`` counts every order that passed the filters.
    return [F.coalesce(F.sum(F.when(F.col("order_status") == COMPLETED, F.col("order_total"))),
                       F.lit(0).cast("decimal(28,2)")).cast("double").alias("gmv"),
            F.count(F.lit(1)).cast("bigint").alias("orders")]


def top_cities_gmv(m: Marts, spec: FilterSpec, n: int = 10) -> DataFrame:
    """Top user cities by GMV (ties by city name; a NULL city is its own group)."""
    return (order_base(m, spec).groupBy("city").agg(*_gmv_orders_all_status())
            .orderBy(F.desc("gmv"), F.asc_nulls_last("city")).limit(n))


def top_vendors_gmv(m: Marts, spec: FilterSpec, n: int = 15) -> DataFrame:
    """Top vendors (vendor_id, vendor city, category) by GMV with their rating and order count.

    The rating is the vendor's own, one value a vendor, so no mean over its orders is taken.
    """
    return (order_base(m, spec).groupBy("vendor_id", F.col("v_city").alias("city"), "category")
            .agg(F.max("rating").alias("rating"), *_gmv_orders_all_status())
            .orderBy(F.desc("gmv"), F.asc("vendor_id")).limit(n))


def top_categories_from_vendors(m: Marts, spec: FilterSpec, n_vendors: int = 15) -> DataFrame:
    """Categories re-aggregated from the top vendors only (the source's category table)."""
    return (top_vendors_gmv(m, spec, n_vendors).groupBy("category")
            .agg(F.sum("gmv").alias("gmv"), F.sum("orders").cast("bigint").alias("orders")))


def top_categories_gmv(m: Marts, spec: FilterSpec) -> DataFrame:
    """Exact variant: every order grouped by vendor category."""
    return order_base(m, spec).groupBy("category").agg(*_gmv_orders_all_status())


_DIM_COLUMN = {Dim.CITY: "city", Dim.CHANNEL: "channel", Dim.DEVICE: "device",
               Dim.CATEGORY: "category", Dim.STATUS: "status"}


def top10_gmv_by_dim(m: Marts, spec: FilterSpec, dim: Dim, n: int = 10) -> DataFrame:
    """Top values of a dimension by GMV over *completed* orders, schema-resolving.

    Vendors are left-joined; a NULL (or unresolvable) dimension is 'UNKNOWN'; without
    a status column every order counts.  No status filter; unknown dimension -> city.
    """
    r = resolve_orders(m.users, m.orders, m.vendors, spec)
    if not r.ok:
        return m.spark.createDataFrame([], "dim string, gmv double, orders bigint")
    dim = Dim(dim)
    if dim not in _DIM_COLUMN:
        dim = Dim.CITY
    present = {Dim.CITY: r.has_city, Dim.CHANNEL: r.has_channel, Dim.DEVICE: r.has_device,
               Dim.CATEGORY: r.has_vendor_category, Dim.STATUS: r.has_status}[dim]
    dim_col = F.col(_DIM_COLUMN[dim]).cast("string") if present else F.lit(None).cast("string")
    zero = F.lit(0).cast("decimal(28,2)")
    if r.has_status:
        done = F.col("status") == COMPLETED
        aggs = [F.coalesce(F.sum(F.when(done, F.col("total"))), zero).cast("double").alias("gmv"),
                F.count_if(done).cast("bigint").alias("orders")]
    else:
        aggs = [F.coalesce(F.sum("total"), zero).cast("double").alias("gmv"),
                F.count(F.lit(1)).cast("bigint").alias("orders")]
    return (r.frame.groupBy(F.coalesce(dim_col, F.lit(UNKNOWN)).alias("dim")).agg(*aggs)
            .orderBy(F.desc("gmv"), F.asc("dim")).limit(n))


def compare_orders_by_dim(m: Marts, spec: FilterSpec, dim: Dim) -> DataFrame:
    """Per value of a dimension: gmv, orders_total, orders_cancelled, commission (NULL value kept)."""
    col = {Dim.CATEGORY: "category", Dim.CITY: "city", Dim.CHANNEL: "acquisition_channel",
           Dim.DEVICE: "device", Dim.STATUS: "order_status"}[Dim(dim)]
    return (order_base(m, spec).groupBy(F.col(col).alias("dim")).agg(*order_metrics())
            .select("dim", "gmv", "orders_total", "orders_cancelled", "commission"))


def compare_orders_trend_top5(m: Marts, spec: FilterSpec, dim: Dim, n: int = 5) -> DataFrame:
    """(day, dim) metrics for the ``n`` largest values by GMV (ties by name).

    Orders are aggregated to (day, dim) once; the top set is a sum over that small frame (its
    exchange is reused) and stays a DataFrame of n rows, broadcast into a semi-join.
    """
    col = {Dim.CATEGORY: "category", Dim.CITY: "city", Dim.CHANNEL: "acquisition_channel",
           Dim.DEVICE: "device", Dim.STATUS: "order_status"}[Dim(dim)]
    done = F.col("order_status") == COMPLETED
    daily = (order_base(m, spec).withColumn("dim", F.col(col)).groupBy("day", "dim")
             .agg(*order_metrics(), F.sum(F.when(done, F.col("order_total"))).alias("_paid")))
    total = F.coalesce(F.sum("_paid"), F.lit(0).cast("decimal(28,2)"))
    top = (daily.groupBy("dim").agg(total.alias("_gmv")).orderBy(F.desc("_gmv"), F.asc_nulls_last("dim")).limit(n)
           .select(F.col("dim").cast("string").alias("top_dim")))
    return (daily.join(F.broadcast(top), F.col("dim").cast("string") == F.col("top_dim"), "left_semi")
            .select("day", "dim", "gmv", "orders_total", "orders_cancelled", "commission"))
