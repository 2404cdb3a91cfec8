"""Row numbers over a whole table, or within groups of any size, without a single-task window.

Rows are range-partitioned by (group, order) and sorted inside partitions, so a partition is a run of the global order.
The sorted table is written once with each row's partition and place in it; what is left is a prefix sum over
partition counts. A task sorts one range and never more, also when one group holds most rows: the order columns
take part in the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.session import written

_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), out: str = "position") -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... by ``order``, from 0 in each ``group``.

    ``order`` decides alone: rows equal in it are numbered in an arbitrary but fixed order. Null groups are a group.
    Offsets between partitions are one row for each partition at most, which is what is broadcast.
    """
    keys = [*(F.col(g).asc() for g in group), *order]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # monotonically_increasing_id: the partition's number above 33 bits of the row's place in it
    laid = written(laid.withColumn("_place", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND(F.lit(_PLACE)))
    counts = laid.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    later = F.broadcast(before.where(F.col("_before") > 0).select(  # groups that go on in a further partition
        F.col("_part").alias("_p"), "_before", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]))
    if group:  # a partition may hold many groups: number inside (partition, group)
        inside = Window.partitionBy("_part", *group).orderBy("_place")
        laid = laid.withColumn("_place", F.row_number().over(inside) - 1)
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    number = (F.coalesce("_before", F.lit(0)) + F.col("_place")).cast("long")
    return laid.join(later, same, "left").select(*df.columns, number.alias(out))
