"""Composite reports: the source dashboards' refresh flows as bundles of lazy DataFrames.

* ``kpi_report``: the KPI refresh (summary row, daily sales, DAU by dimension, top tables).
* ``churn_report``: retrain on a filtered population, score it, and compare the risk
  distribution with the previous model's scores of the previously trained population.

Nothing is collected here except what model training itself needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulse.functions.filters import FilterSpec, filter_in
from pulse.operators import activation, sales
from pulse.operators.churn import metrics as cm
from pulse.operators.churn import model as mm
from pulse.sources.marts import Marts


def kpi_report(m: Marts, spec: FilterSpec) -> dict[str, DataFrame]:
    return {
        "summary": sales.kpi_summary(m, spec),
        "sales_timeseries": sales.sales_timeseries_rates(m, spec),
        "dau_by_dim": activation.dau_by_dim(m, spec),
        "top_cities": sales.top_cities_gmv(m, spec),
        "top_vendors": sales.top_vendors_gmv(m, spec),
    }


def churn_report(features: DataFrame, filters: dict, num_cols: list[str], cat_cols: list[str], label_col: str,
                 id_col: str, previous: mm.ChurnModel | None = None, previous_filters: dict | None = None,
                 threshold: float = 0.60, top_n: int = 20, **train_kw) -> dict:
    """Retrain on ``filters``; score; KPIs, ranking, histogram, stats vs the previous snapshot.

    The previous snapshot is the previous model's scores of the population it was
    trained on (``previous_filters``), as in the source's retrain flow.
    """
    model, info = mm.retrain_on_filter(features, filters, num_cols=num_cols, cat_cols=cat_cols,
                                       label_col=label_col, id_col=id_col, **train_kw)
    scored = mm.score(model, filter_in(features, filters))
    out = {"model": model, "train": info, "scored": scored,
           "kpis": cm.risk_kpis(scored, threshold), "ranking": cm.risk_ranking(scored, top_n),
           "histogram": cm.risk_histogram(scored), "stats": cm.risk_distribution_stats(scored)}
    if previous is not None:
        prev_scored = mm.score(previous, filter_in(features, previous_filters or {}))
        out["stats_vs_previous"] = cm.risk_stats_vs_previous(scored, prev_scored)
    return out
