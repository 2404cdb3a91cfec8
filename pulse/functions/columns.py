"""Scalar column helpers: guarded ratios, labels, money.

Money is summed as decimal and cast to double only at the end, so that a sum does
not depend on the order in which partitions are combined.  Ratios divide exact
integers/decimals once, in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source application's output labels.
UNKNOWN = "UNKNOWN"        # NULL dimension value
NO_PURCHASE = "Sin compra"  # user without a (first) order in the range
TOTAL = "Total"            # total series
OTHERS = "Otros"           # remainder slice after the top-N
COMPLETED = "completed"
CANCELLED = "cancelled"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    """num / den in double; 0.0 when den is 0 or NULL."""
    n, d = c(num), c(den)
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def delta_pct(cur, prev) -> Column:
    """(cur - prev) / prev; 1.0 when prev is 0 and cur > 0; else 0.0."""
    cu, pr = c(cur), c(prev)
    return (
        F.when(pr > 0, (cu - pr).cast("double") / pr.cast("double"))
        .when(cu > 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def money(col) -> Column:
    return c(col).cast("decimal(18,2)")


def money_sum(col) -> Column:
    """Order-independent sum of a money column."""
    return F.sum(money(col))


def to_double(col) -> Column:
    return c(col).cast("double")


def label(col, missing: str = UNKNOWN) -> Column:
    """COALESCE(CAST(col AS text), missing)."""
    return F.coalesce(c(col).cast("string"), F.lit(missing))


def bigint(col) -> Column:
    return c(col).cast("bigint")


def round_half_even(col, digits: int) -> Column:
    """pandas ``round`` (banker's rounding) on a double."""
    return F.bround(c(col), digits)
