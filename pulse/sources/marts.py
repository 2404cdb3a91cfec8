"""The four marketplace tables every KPI query reads, and their fixture derivations.

``Marts`` holds canonical DataFrames:

* users    (user_id, city, acquisition_channel, device, created_at[, deleted_at])
* sessions (user_id, session_date)
* orders   (order_id, user_id, vendor_id, order_date, order_status, order_total, commission[, deleted_at])
* vendors  (vendor_id, city, category, rating[, deleted_at])

Two fixture marts are derived from the driver's TPC-H-like tables (see FIXTURES.md):
an *events* mart (2024 events: sessions, orders, signups) and a *sales* mart
(TPC-H orders 1995-2001).  Both are plain lazy projections; on a cluster they would
be materialised once with :func:`materialize`, partitioned by day.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.dates import day_partition
from pulse.sources.tables import Tables


@dataclasses.dataclass(frozen=True)
class Marts:
    users: DataFrame
    sessions: DataFrame
    orders: DataFrame
    vendors: DataFrame | None

    @property
    def spark(self) -> SparkSession:
        return self.users.sparkSession

    def live(self) -> "Marts":
        """Soft-delete filter on each input that has ``deleted_at``.

        Equivalent to the source's placement (orders in WHERE, users in the inner
        join, vendors in the LEFT JOIN condition): filtering each side first gives
        the same rows for inner and left joins.
        """
        def alive(df):
            if df is None or "deleted_at" not in df.columns:
                return df
            return df.filter(F.col("deleted_at").isNull()).drop("deleted_at")
        return Marts(alive(self.users), alive(self.sessions), alive(self.orders), alive(self.vendors))


def _users(t: Tables, created_at_sql: str) -> DataFrame:
    region = t.region.select("r_regionkey", "r_name")
    nation = t.nation.select("n_nationkey", "n_regionkey")
    return (
        t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("user_id"),
            F.when(F.col("c_custkey") % 50 != 0, F.col("c_mktsegment")).alias("city"),
            F.col("r_name").alias("acquisition_channel"),
            F.when(F.col("c_custkey") % 3 == 0, F.lit("android"))
             .when(F.col("c_custkey") % 3 == 1, F.lit("ios"))
             .otherwise(F.lit("web")).alias("device"),
            F.expr(created_at_sql).alias("created_at"),
        )
    )


def events_mart(spark: SparkSession, sf_dir: str) -> Marts:
    """Users from customers, sessions and orders from the 2024 ``events`` stream."""
    t = Tables(spark, sf_dir)
    users = _users(
        t,
        "timestamp_ntz'2023-12-01 00:00:00' + "
        "make_dt_interval(cast((c_custkey * 37) % 62 AS int), cast(c_custkey % 24 AS int))",
    )
    vendors = (
        t.part.select(F.col("p_partkey").alias("vendor_id"), F.col("p_brand").alias("city"),
                F.col("p_type").alias("category"), (F.col("p_size").cast("double") / 10).alias("rating"))
    )
    ev = t.events
    sessions = (
        ev.filter(F.col("event_type").isin("view", "click", "signup"))
        .select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("session_date"))
    )
    total = F.col("value").cast("decimal(18,2)")
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("bigint")
    # orders go to vendors over all part keys; a tenth of them names no vendor
    n_parts = F.broadcast(t.part.agg(F.count(F.lit(1)).alias("n_parts")))  # one row
    orders = (
        ev.filter(F.col("event_type").isin("purchase", "error")).crossJoin(n_parts)
        .select(
            F.col("event_id").alias("order_id"),
            "user_id",
            F.when(k < 90, (F.col("event_id") * 31 + k) % F.col("n_parts")).alias("vendor_id"),
            F.col("ts").alias("order_date"),
            F.when(F.col("event_id") % 10 == 0, F.lit("pending"))
             .when(F.col("event_type") == "purchase", F.lit("completed"))
             .otherwise(F.lit("cancelled")).alias("order_status"),
            total.alias("order_total"),
            (total * F.lit(0.1).cast("decimal(2,1)")).cast("decimal(18,2)").alias("commission"),
        )
    )
    return Marts(users, sessions, orders, vendors)


def sales_mart(spark: SparkSession, sf_dir: str) -> Marts:
    """Users from customers, orders from TPC-H orders; vendor = smallest supplier on the order."""
    t = Tables(spark, sf_dir)
    users = _users(t, "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast((c_custkey * 37) % 2400 AS int))")
    nation = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    region = t.region.select("r_regionkey", "r_name")
    vendors = (
        t.supplier.select("s_suppkey", "s_nationkey")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("vendor_id"), F.col("n_name").alias("city"),
                F.col("r_name").alias("category"),
                ((F.lit(10) + F.col("s_suppkey") % 41).cast("double") / 10).alias("rating"))
    )
    # Join first, then aggregate grouped by the order columns: a query's date filter on
    # order_date is a filter on a grouping column, so Catalyst pushes it below the
    # aggregate and the join into the orders scan.  Lineitems then meet only the
    # orders of the range (broadcast when that set is small) and are reduced to one
    # row per order by a map-side partial aggregate before any shuffle.
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    per_order = (t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
                 .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
                 .groupBy("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
                 .agg(F.min("l_suppkey").alias("vendor_id")))
    total = F.col("o_totalprice").cast("decimal(18,2)")
    orders = (
        per_order
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            "vendor_id",
            F.col("o_orderdate").alias("order_date"),
            F.when(F.col("o_orderstatus") == "F", F.lit("completed"))
             .when(F.col("o_orderstatus") == "P", F.lit("cancelled"))
             .otherwise(F.lit("pending")).alias("order_status"),
            total.alias("order_total"),
            (total * F.lit(0.1).cast("decimal(2,1)")).cast("decimal(18,2)").alias("commission"),
        )
    )
    # the sales fixture has no session stream: an empty table with the sessions schema
    sessions = spark.createDataFrame([], "user_id bigint, session_date timestamp_ntz")
    return Marts(users, sessions, orders, vendors)


def materialize(marts: Marts, path: str, mode: str = "overwrite") -> Marts:
    """Write the marts once (facts partitioned by day) and read them back.

    This is the deployment path: the derived tables are computed once, then every
    dashboard query prunes day partitions instead of re-deriving them.  Facts keep
    their partition column (``<ts>__day``), which ``day_range`` filters, and rows
    are sorted by time inside each file so row-group statistics are tight.
    """
    spark = marts.spark
    out = {}
    # Each user's first order day (any status, whole history) is kept on the users
    # table: 7-day activation then needs no order scan.
    first = marts.orders.groupBy("user_id").agg(F.min(F.to_date("order_date")).alias("first_order_day"))
    users = marts.users.join(first, "user_id", "left")
    for name, df, ts in (("users", users, None), ("sessions", marts.sessions, "session_date"),
                         ("orders", marts.orders, "order_date"), ("vendors", marts.vendors, None)):
        if df is None:
            out[name] = None
            continue
        target = f"{path}/{name}"
        if ts is not None:
            part = day_partition(ts)
            # range partitioning on (day, time) splits a hot day over several writers
            (df.withColumn(part, F.to_date(ts)).repartitionByRange(F.col(part), F.col(ts))
             .sortWithinPartitions(ts).write.mode(mode).partitionBy(part).parquet(target))
        else:
            df.write.mode(mode).parquet(target)
        out[name] = spark.read.parquet(target)
    return Marts(out["users"], out["sessions"], out["orders"], out["vendors"])
