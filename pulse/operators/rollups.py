"""Upkeep of daily order rollups under late, changed and deleted orders.

The rollup has a folder for each day. A batch of changes touches the days of the orders' new versions and of the versions they
replace; those days are added up again from the orders as they are now and swapped in by dynamic partition overwrite.
Every other day's files stay as they are. A day that loses its last order keeps a row of zeros, which readers
skip, since an overwrite cannot take a folder away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.dates import day_partition
from pulse.operators.common import order_metrics

COLUMNS = ["order_id", "user_id", "vendor_id", "order_date", "order_status", "order_total", "commission"]


def _days(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.to_date("order_date").alias("day")).agg(*order_metrics())


def _store(rollup: DataFrame, path: str) -> None:
    rollup.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def build(orders: DataFrame, path: str) -> None:
    """The rollup of all orders: (day, orders_total, orders_completed, orders_cancelled, gmv, commission)."""
    _store(_days(orders), path)


def read(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("orders_total") > 0)


def latest_versions(changes: DataFrame) -> DataFrame:
    """One row for each changed order: its last version by ``changed_at``, at a tie one that deletes it."""
    last = F.max_by(F.struct(*COLUMNS, "deleted"), F.struct("changed_at", "deleted", *COLUMNS))
    return changes.groupBy(F.col("order_id").alias("_id")).agg(last.alias("v")).select("v.*")


def merged(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """The orders as they are after the changes."""
    last = latest_versions(changes)
    return (orders.select(*COLUMNS).join(last.select("order_id"), "order_id", "left_anti")
            .unionByName(last.where(~F.col("deleted")).select(*COLUMNS)))


def apply_changes(orders: DataFrame, changes: DataFrame, path: str) -> list:
    """Bring the rollup up to date with ``changes`` (the columns of orders, deleted boolean, changed_at) on ``orders`` as they
    were before; returns the days that were written again (as many as the batch touches, known to the driver)."""
    last = latest_versions(changes)
    was = orders.join(last.select("order_id"), "order_id", "left_semi").select(F.to_date("order_date").alias("day"))
    now = last.where(~F.col("deleted")).select(F.to_date("order_date").alias("day"))
    days = sorted(r[0] for r in was.unionAll(now).where(F.col("day").isNotNull()).distinct().collect())
    if not days:
        return days
    part = day_partition("order_date")
    here = F.to_date("order_date").isin(days)
    some = orders.where(here & F.col(part).isin(days)) if part in orders.columns else orders.where(here)
    again = _days(merged(some, changes).where(here))
    spark = orders.sparkSession
    touched = spark.createDataFrame([(d,) for d in days], "day date")
    zeros = {c: 0 for c in again.columns if c != "day"}
    _store(touched.join(again, "day", "left").fillna(zeros).select(again.columns), path)
    return days
