"""Registry of named, parameter-bound queries: the Spark plan and its DuckDB oracle.

Each entry reads the driver tables of one scale-factor directory, derives a mart
from them and runs one operator with pinned parameters (``pulse.plans.params``).
``oracle`` is None for operators that SQL cannot state (model training/scoring).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulse.session import prepare
from pulse.sources.marts import Marts, events_mart, sales_mart
from pulse.sources.tables import Tables


@dataclasses.dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    group: str


REGISTRY: dict[str, Entry] = {}


# Lazy plans (not data) of the marts and raw tables, reused across queries of one
# application and data folder, like prepared statements: building and analysing a
# DataFrame costs driver time, and the plans do not change between queries.
_PLANS: dict = {}


def _key(spark: SparkSession, sf_dir: str, kind: str):
    return (spark.sparkContext.applicationId, sf_dir, kind)


def marts(spark: SparkSession, sf_dir: str, kind: str) -> Marts:
    prepare(spark)
    k = _key(spark, sf_dir, kind)
    if k not in _PLANS:
        _PLANS[k] = (events_mart if kind == "events" else sales_mart)(spark, sf_dir).live()
    return _PLANS[k]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    prepare(spark)
    k = _key(spark, sf_dir, "tables")
    if k not in _PLANS:
        _PLANS[k] = Tables(spark, sf_dir)
    return _PLANS[k]


def cached(spark: SparkSession, sf_dir: str, name: str, build):
    """A derived table kept for the session (built by ``build()`` on first use)."""
    k = _key(spark, sf_dir, name)
    if k not in _PLANS:
        _PLANS[k] = build()
    return _PLANS[k]


def clear_plans() -> None:
    _PLANS.clear()


def register(name: str, group: str, oracle: str | None, mart: str | None = None):
    """Register ``fn(marts)`` (when ``mart`` is given) or ``fn(spark, sf_dir)``."""
    def deco(fn):
        if mart is not None:
            def run(spark, sf_dir, _fn=fn, _kind=mart):
                return _fn(marts(spark, sf_dir, _kind))
        else:
            def run(spark, sf_dir, _fn=fn):
                prepare(spark)
                return _fn(spark, sf_dir)
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, run, oracle, group)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    """Import every query module so that its registrations run."""
    from pulse.plans import (q_acquisition, q_activation, q_churn, q_experiments,  # noqa: F401
                             q_kept, q_operations, q_sales, q_sources)
    return REGISTRY
