"""Filter option lists: distinct values of each filterable dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.sources.marts import Marts


def filter_options(m: Marts) -> DataFrame:
    """Long form (dimension, value) of the distinct city, channel, device and category values.

    A NULL value is kept as its own option (the source's array aggregate keeps it).  Each table is
    read once: a row lists its dimensions' values, which are made distinct by a partial aggregate.
    """
    def values(df: DataFrame, cols: dict[str, str]) -> DataFrame:
        pairs = [F.struct(F.lit(name).alias("dimension"), F.col(col).cast("string").alias("value")) for name, col in cols.items()]
        return df.select(F.explode(F.array(*pairs)).alias("o")).select("o.dimension", "o.value").distinct()

    out = values(m.users, {"city": "city", "channel": "acquisition_channel", "device": "device"})
    if m.vendors is not None and "category" in m.vendors.columns:  # no vendors: no category filter
        out = out.unionByName(values(m.vendors, {"category": "category"}))
    return out


def option_lists(m: Marts) -> DataFrame:
    """Wide form: one sorted array per dimension (NULLs dropped, ``has_null`` flag kept)."""
    opts = filter_options(m)
    return opts.groupBy("dimension").agg(F.array_sort(F.collect_set("value")).alias("values"),
                                         F.max(F.col("value").isNull()).alias("has_null"))
