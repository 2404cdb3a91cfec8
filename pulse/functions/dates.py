"""Day arithmetic: day keys, range predicates, calendar spines and equal-length bins.

A calendar spine is generated with ``explode(sequence(d1, d2))`` from a one-row
frame: its size is bounded by the number of days in the range, so joining it
(or exploding it next to a series list) never grows with the facts.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def day(col: str | Column) -> Column:
    """Calendar day of a timestamp (session time zone, pinned to UTC)."""
    return F.to_date(F.col(col) if isinstance(col, str) else col)


def in_days(col: str | Column, d1: date, d2: date) -> Column:
    """``col::date BETWEEN d1 AND d2``.

    Catalyst unwraps the date cast into a timestamp range, so the predicate
    reaches the Parquet scan as a pushed filter (row-group pruning).
    """
    return day(col).between(F.lit(d1), F.lit(d2))


def day_partition(ts_col: str) -> str:
    """Name of the day-partition column that a materialised fact keeps for ``ts_col``."""
    return f"{ts_col}__day"


def day_range(df: DataFrame, ts_col: str, d1: date, d2: date) -> DataFrame:
    """Rows whose ``ts_col`` day is in [d1, d2].

    When the table is stored partitioned by day (it carries ``<ts_col>__day``), the
    same range is also applied to the partition column, so whole day folders are
    pruned at planning time (``PartitionFilters``) on top of row-group pushdown.
    """
    out = df.filter(in_days(ts_col, d1, d2))
    part = day_partition(ts_col)
    if part in df.columns:
        out = out.filter(F.col(part).between(F.lit(d1), F.lit(d2)))
    return out


def before_day(col: str | Column, d1: date) -> Column:
    return day(col) < F.lit(d1)


def month_bounds(d: date) -> tuple[date, date]:
    """[first day of d's month, first day of next month)."""
    start = d.replace(day=1)
    nxt = (start.replace(year=start.year + 1, month=1) if start.month == 12
           else start.replace(month=start.month + 1))
    return start, nxt


def day_sequence(d1: date, d2: date, step_days: int = 1) -> Column:
    return F.sequence(F.lit(d1), F.lit(d2), F.expr(f"INTERVAL {int(step_days)} DAYS"))


def calendar(spark: SparkSession, d1: date, d2: date, name: str = "day") -> DataFrame:
    """One row per day in [d1, d2]; empty when d2 < d1."""
    if d2 < d1:
        return spark.createDataFrame([], f"{name} date")
    return spark.range(1).select(F.explode(day_sequence(d1, d2)).alias(name))


def with_days(series: DataFrame, d1: date, d2: date, name: str = "day") -> DataFrame:
    """Every row of a (small, bounded) series list repeated for each day: a generator, not a join."""
    return series.withColumn(name, F.explode(day_sequence(d1, d2)))


def bin_starts(d1: date, d2: date, period_days: int) -> list[date]:
    """Starts of equal-length bins from d1 stepping by ``period_days`` while <= d2."""
    out, cur = [], d1
    while cur <= d2:
        out.append(cur)
        cur = cur + timedelta(days=period_days)
    return out


def bin_index(day_col: Column, start: date, period_days: int) -> Column:
    """floor((day - start) / period): the equi-join form of ``day BETWEEN bin_start AND bin_end``."""
    return F.floor(F.datediff(day_col, F.lit(start)) / F.lit(int(period_days))).cast("bigint")


def mmdd_label(start_col: Column, period_days: int) -> Column:
    """'mm-dd→mm-dd' label of a bin."""
    end_col = F.date_add(start_col, int(period_days) - 1)
    return F.concat(F.date_format(start_col, "MM-dd"), F.lit("→"), F.date_format(end_col, "MM-dd"))
