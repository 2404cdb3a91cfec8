"""Helpers shared by the operators: session preparation, lineage cuts, row payloads, gapless ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.session import checkpoint_dir, ensure_test_checkpoint_dir, prepare, ship

#: Documents that one Arrow batch carries to a Python worker; bounds its memory for long texts.
ARROW_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: UTC, and small Arrow batches."""
    prepare(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet below the cluster's checkpoint folder and read it back.

    The written table ends the lineage: passes over it survive lost executors and never recompute what lies
    before. The folder is the one named in ``spark.checkpoint.dir``; only where that is unset (tests) a
    scratch folder is used. ``parts``: files at most, for tables known to be small.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark) or ensure_test_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/pulse-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def payload(df: DataFrame, *used: str) -> Column:
    """All columns but ``used`` as one struct ``row``: whatever their names, they clash with nothing."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return (F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))).alias("row")


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A seeded 63-bit hash, equal on equal values."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 63) - 1))


def gapless(df: DataFrame, group: list[str], order: str, ties: list[str], rows_per_bucket: int, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each ``group`` by the hash column ``order`` (63 bits), then ``ties``.

    No group is ever sorted by one task: its rows are dealt by ``order`` into buckets of about
    ``rows_per_bucket`` rows; bucket sizes are summed up, and rows are numbered inside buckets.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    shift = 63 - max(0, (most // rows_per_bucket)).bit_length()
    df = df.withColumn("_b", F.shiftright(F.col(order), shift))
    counts = df.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_b").orderBy(order, *ties)
    numbered = df.withColumn("_i", F.row_number().over(inside) - 1)
    on = [numbered[c].eqNullSafe(counts[c]) for c in (*group, "_b")]
    keep = [numbered[c] for c in df.columns if c != "_b"]
    return numbered.join(counts, on).select(*keep, (F.col("_before") + F.col("_i")).cast("long").alias(out))
