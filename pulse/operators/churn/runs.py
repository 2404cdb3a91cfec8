"""Scoring runs that remember their filters, metrics and scores, and their comparison with the run before.

The source keeps "previous" filters and scores in the memory of one browser session; here they are runs of a
``RunStore``, so the comparison survives restarts, names the filters of both sides, and can be asked as of a date.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.filters import filter_in
from pulse.operators.churn import metrics as cm
from pulse.operators.churn import model as mm
from pulse.sources.runs import Run, RunStore


def filters_text(filters: dict[str, list[str]]) -> str:
    return ";".join(f"{k}={','.join(v)}" for k, v in sorted(filters.items()) if v)


def record_scores(store: RunStore, run_id: str, run_ts: datetime, scored: DataFrame, filters: dict[str, list[str]],
                  metrics: dict | None = None) -> Run:
    """Keep a scored population with the filters that chose it."""
    return store.write(run_id, run_ts, {"scores": scored}, {"filters": filters, "metrics": metrics or {}})


def retrain_run(store: RunStore, run_id: str, run_ts: datetime, features: DataFrame, filters: dict[str, list[str]],
                **train_kw) -> tuple[mm.ChurnModel, Run]:
    """Train on the population that passes ``filters``, score it, and keep the scores as a run."""
    model, _ = mm.retrain_on_filter(features, filters, **train_kw)
    return model, record_scores(store, run_id, run_ts, mm.score(model, filter_in(features, filters)), filters, model.metrics)


def compare_latest(store: RunStore, as_of: datetime | None = None) -> DataFrame:
    """(metric, current, previous, current_run, previous_run, current_filters, previous_filters) of the latest two complete
    runs; the previous side is null after a first run. Without any run: an error."""
    runs = store.latest(2, as_of)
    if not runs:
        raise LookupError("no complete run" + (f" as of {as_of}" if as_of else ""))
    now, before = runs[0], runs[1] if len(runs) > 1 else None
    current = store.frame(now, "scores")
    previous = store.frame(before, "scores") if before else current.where("false")

    def side(run: Run | None, name: str) -> list:
        text = [run.run_id, filters_text(run.info["filters"])] if run else [None, None]
        return [F.lit(t).cast("string").alias(f"{name}_{k}") for t, k in zip(text, ("run", "filters"), strict=True)]

    return cm.risk_stats_vs_previous(current, previous).select("metric", "current", "previous", *side(now, "current"), *side(before, "previous"))
