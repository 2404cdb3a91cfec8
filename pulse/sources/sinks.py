"""Sinks: CSV exports and the alert snapshot table.

The source exports its summary tables as CSV (Latin-1, one file per download) and
keeps dated alert files.  Here the data frame stays the query result; the writers
are thin, distributed ``DataFrameWriter`` calls to a shared path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LATIN1 = "ISO-8859-1"


def write_csv(df: DataFrame, path: str, encoding: str = LATIN1, single_file: bool = False,
              mode: str = "overwrite") -> None:
    """CSV with a header row.  ``single_file`` only for small summary tables (one task writes)."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", True).option("encoding", encoding)
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def append_alert_snapshot(alerts: DataFrame, path: str) -> None:
    """Append one alert batch to a Parquet table partitioned by run date.

    Each batch carries its own ``run_ts``; re-running a batch with the same ``run_ts``
    replaces only that run's partition (dynamic partition overwrite).
    """
    (alerts.withColumn("run_date", F.to_date("run_ts"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date", "run_ts").parquet(path))


def read_alert_snapshots(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_two_runs(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, previous) alert batches by ``run_ts``: the inputs of the stats comparison.

    The two run timestamps are found by a top-2 over distinct ``run_ts`` values
    (a handful of partitions), then each batch is a partition-pruned filter.
    """
    runs = snapshots.select("run_ts").distinct().orderBy(F.desc("run_ts")).limit(2)
    ranked = runs.withColumn("_i", F.row_number().over(Window.orderBy(F.desc("run_ts"))))  # two rows
    cur = snapshots.join(F.broadcast(ranked.filter("_i = 1").select("run_ts")), "run_ts", "left_semi")
    prev = snapshots.join(F.broadcast(ranked.filter("_i = 2").select("run_ts")), "run_ts", "left_semi")
    return cur, prev
