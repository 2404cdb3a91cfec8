"""Share tables: fraction of total, top-N with an 'Otros' remainder, top-table normalisation.

Totals are one-row aggregates joined back (broadcast of one row), never a global
window over the input, so no single task receives every group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import OTHERS, ratio
from pulse.operators.common import attach

# Fixed priority lists of the top-table normaliser.
DIM_COLUMN_PRIORITY = ["dim", "city", "category", "vendor", "vendor_name", "series"]
GMV_ALIASES = ["GMV", "total_gmv", "order_total", "sales"]
ORDERS_ALIASES = ["orders_total", "order_count", "num_orders", "orders_completed"]


def with_share(df: DataFrame, value_col: str, share_col: str = "share") -> DataFrame:
    """Adds value / total (0.0 when the total is 0)."""
    tot = df.agg(F.sum(value_col).alias("_total"))
    return df.transform(attach(tot)).withColumn(share_col, ratio(value_col, "_total")).drop("_total")


def share_top_n_others(df: DataFrame, value_col: str, series_col: str = "series", n: int = 8) -> DataFrame:
    """Rows sorted by share (desc, then name); the first ``n`` kept, the rest summed into 'Otros'.

    Output (series, share, value).  The top-N is a TakeOrderedAndProject (n rows per
    task); the remainder is the total minus the kept rows, so no rank column over the
    whole input is needed.
    """
    s = with_share(df.select(F.col(series_col).cast("string").alias("series"),
                             F.col(value_col).cast("double").alias("value")), "value")
    top = s.orderBy(F.desc("share"), F.asc_nulls_last("series")).limit(n)
    totals = s.agg(F.count(F.lit(1)).alias("n_all"), F.sum("value").alias("value_all"))
    kept = top.agg(F.sum("value").alias("value_kept"))
    rest_value = F.col("value_all") - F.col("value_kept")
    rest = (totals.transform(attach(kept)).filter(F.col("n_all") > n)
            .select(F.lit(OTHERS).alias("series"), ratio(rest_value, "value_all").alias("share"),
                    rest_value.alias("value")))
    return top.select("series", "share", "value").unionByName(rest)


def centre_total(shares_frame: DataFrame, value_col: str = "value") -> DataFrame:
    """One row (total): the number in the centre of a share chart, the sum of all its parts."""
    return shares_frame.agg(F.coalesce(F.sum(value_col), F.lit(0.0)).alias("total"))


def normalize_top(df: DataFrame, preferred_dim_col: str | None = None) -> DataFrame:
    """Any top table -> (dim, gmv, orders).

    Dimension column: the preferred one, else the first of a fixed priority list, else
    the first string column, else the first column.  Metrics by alias lists, coerced
    to numbers (invalid -> 0).
    """
    cols = df.columns
    if preferred_dim_col and preferred_dim_col in cols:
        dim_col = preferred_dim_col
    else:
        dim_col = next((c for c in DIM_COLUMN_PRIORITY if c in cols), None)
        if dim_col is None:
            strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
            dim_col = strings[0] if strings else cols[0]
    gmv = "gmv" if "gmv" in cols else next((c for c in GMV_ALIASES if c in cols), None)
    orders = "orders" if "orders" in cols else next((c for c in ORDERS_ALIASES if c in cols), None)
    gmv_c = F.coalesce(F.col(gmv).cast("string").try_cast("double"), F.lit(0.0)) if gmv else F.lit(0.0)
    orders_c = (F.coalesce(F.col(orders).cast("string").try_cast("double"), F.lit(0.0)).cast("bigint")
                if orders else F.lit(0).cast("bigint"))
    return df.select(F.coalesce(F.col(dim_col).cast("string"), F.lit("None")).alias("dim"),
                     gmv_c.alias("gmv"), orders_c.alias("orders"))
