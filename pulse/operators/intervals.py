"""Joins of days to intervals of any lengths that may overlap.

``day BETWEEN start AND end`` alone plans as a nested loop over all pairs. Here intervals are cut over a grid: an interval gets
the coarsest-enough level on which it covers few cells, at most ``FAN`` + 1, and a row for each; a fact has one cell on
each level that occurs. Facts and intervals meet by an equi-join on (level, cell), and the exact test is a
condition of that join. So an interval that covers everything costs as few rows as a short one.

A cell with very many facts (a hot day) is split by ``salts``: facts are dealt, the cell's intervals repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.dates import day_range
from pulse.functions.filters import FilterSpec
from pulse.operators.common import active_pairs
from pulse.sources.marts import Marts

#: Days of a cell of level 0, and how many cells of a level make one of the next.
GRID, FAN, LEVELS = 8, 16, 5


def _width(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(GRID * FAN**i).cast("long") for i in range(LEVELS)]), level + 1)


def spans(spark: SparkSession, named: Sequence[tuple[str, date, date]]) -> DataFrame:
    """(span, start_day, end_day) of a parameter list; both ends belong to a span."""
    return spark.createDataFrame([tuple(n) for n in named], "span string, start_day date, end_day date")


def interval_join(facts: DataFrame, day: str, intervals: DataFrame, start: str, end: str, salts: int = 1) -> DataFrame:
    """Every (fact, interval) with ``start <= day <= end`` as one row with the columns of both.

    Null days or ends match nothing, nor does an interval that ends before it starts. Which levels occur is
    read from the intervals when called (at most ``LEVELS`` values).
    """
    first, last = F.unix_date(start).cast("long"), F.unix_date(end).cast("long")
    length = last - first + 1
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        level = F.when(length <= GRID * FAN ** (i + 1), F.lit(i)).otherwise(level)
    cut = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    used = [r[0] for r in cut.select("_level").distinct().collect()]
    cells = F.sequence(F.floor(first / _width(F.col("_level"))), F.floor(last / _width(F.col("_level"))))
    cut = cut.withColumn("_cell", F.explode(cells)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    at = F.unix_date(day).cast("long")
    probes = facts.where(F.col(day).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    probes = probes.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in sorted(used)]).cast("array<int>")))
    probes = probes.withColumn("_cell", F.floor(at / _width(F.col("_level"))))
    left, right = probes.alias("f"), cut.alias("i")
    same = [F.col(f"f.{k}") == F.col(f"i.{k}") for k in ("_level", "_cell", "_salt")]
    inside = F.col(f"f.{day}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))
    return left.join(right, [*same, inside]).select(
        *[F.col(f"f.`{c}`") for c in facts.columns], *[F.col(f"i.`{c}`") for c in intervals.columns])


def active_users_in_spans(m: Marts, spec: FilterSpec, named: Sequence[tuple[str, date, date]], salts: int = 1) -> DataFrame:
    """(span, start_day, end_day, active_users): distinct users with a session in each span; spans without any have 0.

    Sessions are reduced to distinct (user, day) before they meet the spans; users are distinct per span
    by an aggregate with a map-side part.
    """
    listed = spans(m.spark, named)
    pairs = active_pairs(m, spec, min(n[1] for n in named), max(n[2] for n in named))
    met = interval_join(pairs, "day", listed, "start_day", "end_day", salts)
    counts = met.select("span", "user_id").distinct().groupBy("span").agg(F.count(F.lit(1)).alias("active_users"))
    return listed.join(counts, "span", "left").select("span", "start_day", "end_day", F.coalesce("active_users", F.lit(0)).cast("bigint").alias("active_users"))


def spend_in_spans(m: Marts, named: Sequence[tuple[str, date, date]]) -> DataFrame:
    """(span, orders, revenue): orders and their money in each span, whatever their status; orders of a day are added up first."""
    listed = spans(m.spark, named)
    orders = day_range(m.orders, "order_date", min(n[1] for n in named), max(n[2] for n in named))
    daily = orders.groupBy(F.to_date("order_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("order_total").cast("decimal(18,2)")).alias("money"))
    met = interval_join(daily, "day", listed, "start_day", "end_day").groupBy("span").agg(
        F.sum("n").alias("orders"), F.sum("money").cast("double").alias("revenue"))
    return listed.select("span").join(met, "span", "left").select(
        "span", F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"))
