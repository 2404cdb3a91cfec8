"""Physical-plan rules for every registered non-model query.

* no CartesianProduct (cross joins only against one-row or parameter-bounded frames,
  which plan as broadcast nested-loop joins);
* every scan of a fact table (events, orders) carries a pushed predicate on its time column, with a
  lower bound except where the whole past counts (FULL_PAST); churn features and A/B summaries need
  full history by definition;
* a user's rows are aggregated below the first exchange wherever a hot user could be (HOT_USER).
"""

import re

import pytest

from pulse.plans.catalog import load_all

from conftest import SF_SMALL

REG = load_all()
MODEL = {"train_metrics", "score_customers", "model_risk_ranking", "feature_importance", "retrain_on_filter"}
MODEL |= {f"{n}_digest" for n in MODEL}
NAMES = sorted(n for n in REG if n not in MODEL)
FULL_HISTORY_GROUPS = {"churn", "experiments"}
FULL_PAST = {"activation_7d", "kpi_summary", "kpi_summary_empty_range"}  # an order before signup counts as well
HOT_USER = ["new_users_by_first_order_dim", "activation_7d", "active_users_by_bins", "active_users_by_first_order_dim"]


def _plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _scans(plan: str):
    """(table file, pushed filters) for each parquet scan in a formatted plan."""
    out = []
    for block in plan.split("\n\n"):
        if "Scan parquet" not in block:
            continue
        loc = re.search(r"Location: \S+ \[([^\]]*)\]", block)
        pushed = re.search(r"PushedFilters: \[(.*)\]", block)
        out.append((loc.group(1) if loc else "", pushed.group(1) if pushed else ""))
    return out


@pytest.mark.parametrize("name", NAMES)
def test_plan_rules(spark, name):
    e = REG[name]
    plan = _plan(e.run(spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    if e.group in FULL_HISTORY_GROUPS:
        return
    bound = r"(GreaterThanOrEqual|LessThan)" if name in FULL_PAST else r"GreaterThanOrEqual"
    for loc, pushed in _scans(plan):
        if "events.parquet" in loc:
            assert re.search(bound + r"\(ts,", pushed), (loc, pushed)
        if "/orders.parquet" in loc:
            assert re.search(bound + r"\(o_orderdate,", pushed), (loc, pushed)


def _walk(node, above):
    """(node name, names above it) of a physical plan, top down."""
    yield node, above
    for i in range(node.children().size()):
        yield from _walk(node.children().apply(i), [*above, node.nodeName()])


@pytest.mark.parametrize("name", HOT_USER)
def test_hot_user_is_reduced_below_the_first_exchange(spark, name):
    """From the scan of a fact up, the first exchange gets the output of a partial aggregate."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = REG[name].run(spark, SF_SMALL)._jdf.queryExecution().executedPlan()
        plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
        facts = [above for node, above in _walk(plan, []) if "Scan parquet" in node.nodeName() and "events.parquet" in node.toString()]
        assert facts
        for above in facts:
            upward = above[::-1]
            first = next(i for i, n in enumerate(upward) if n == "Exchange")
            assert any("HashAggregate" in n or "ObjectHashAggregate" in n or "SortAggregate" in n for n in upward[:first]), upward
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
