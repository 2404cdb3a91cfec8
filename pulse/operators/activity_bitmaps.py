"""Exact distinct users over any range of days from day bitmaps.

Sessions are read once: each (day, dimension, series) keeps its users as bitmaps, 32,768 user ids to a bucket of 4 kB.
Bitmaps of several days are merged by bitwise or, so the users of any range come out exactly, and no session is
read again. A user counts once however many sessions there are: a user with a third of all sessions sets one bit a
day. Ids should be dense, as generated keys are; an id far from others costs a bucket of its own.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import TOTAL, label
from pulse.functions.filters import FilterSpec
from pulse.operators.common import active_pairs
from pulse.sources.marts import Marts

DIMS = {"city": "city", "channel": "acquisition_channel", "device": "device"}
KEY = ["dim", "series", "bucket"]


def day_bitmaps(m: Marts, spec: FilterSpec, d1: date, d2: date) -> DataFrame:
    """(day, dim, series, bucket, users): the users seen on each day of [d1, d2], in total and by city, channel and device."""
    pairs = active_pairs(m, spec, d1, d2, tuple(DIMS.values()))
    lines = [F.struct(F.lit("total").alias("dim"), F.lit(TOTAL).alias("series"))]
    lines += [F.struct(F.lit(d).alias("dim"), label(c).alias("series")) for d, c in DIMS.items()]
    rows = pairs.select("day", "user_id", F.explode(F.array(*lines)).alias("s")).select("day", "user_id", "s.dim", "s.series")
    return (rows.groupBy("day", "dim", "series", F.bitmap_bucket_number("user_id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users")))


def write_bitmaps(bitmaps: DataFrame, path: str) -> DataFrame:
    """Keep the bitmaps, a folder for each day; days written again replace theirs."""
    (bitmaps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
    return bitmaps.sparkSession.read.parquet(path)


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    merged = rows.groupBy(*by, *KEY).agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy(*by, "dim", "series").agg(F.sum(F.bitmap_count("users")).cast("bigint").alias("active_users"))


def active_between(bitmaps: DataFrame, d1: date, d2: date) -> DataFrame:
    """(dim, series, active_users): distinct users of the days [d1, d2]."""
    return _counted(bitmaps.where(F.col("day").between(F.lit(d1), F.lit(d2))), [])


def active_by_grain(bitmaps: DataFrame, d1: date, d2: date, trailing: int = 7) -> DataFrame:
    """(grain, period, dim, series, active_users) from one pass over the bitmaps of [d1, d2].

    grain ``day``: a day's users; ``trailing``: those of the ``trailing`` days that end on ``period``, for whole windows only;
    ``month``: those of the calendar month that begins on ``period``, as far as it lies in [d1, d2].
    """
    day = F.col("day")
    windows = F.transform(F.sequence(F.lit(0), F.lit(trailing - 1)), lambda i: F.struct(
        F.lit("trailing").alias("grain"), F.date_add(day, i).alias("period")))
    others = F.array(F.struct(F.lit("day").alias("grain"), day.alias("period")),
                     F.struct(F.lit("month").alias("grain"), F.trunc(day, "month").alias("period")))
    rows = bitmaps.where(day.between(F.lit(d1), F.lit(d2))).select(F.explode(F.concat(others, windows)).alias("g"), *KEY, "users")
    rows = rows.select("g.grain", "g.period", *KEY, "users")
    whole = F.col("period").between(F.lit(d1 + timedelta(days=trailing - 1)), F.lit(d2))
    return _counted(rows.where((F.col("grain") != "trailing") | whole), ["grain", "period"])
