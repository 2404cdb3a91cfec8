"""pulse: marketplace and churn analytics as lazy Spark DataFrame operators.

Every operator takes input DataFrames (a :class:`~pulse.sources.marts.Marts`
bundle) plus an explicit :class:`~pulse.functions.filters.FilterSpec` and
returns a lazy DataFrame.  Nothing is collected inside an operator except a
handful of scalars in the exact order-statistic helper and model metadata.
"""

from pulse.functions.filters import Dim, FilterSpec
from pulse.sources.marts import Marts

__all__ = ["Dim", "FilterSpec", "Marts"]
