"""Materialised marts (facts partitioned by day) give the same answers and prune partitions."""

from pulse.operators import activation as act
from pulse.operators import operations as ops
from pulse.operators import sales
from pulse.plans.params import P1
from pulse.sources.marts import events_mart, materialize

from conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_materialized_marts_prune_and_agree(spark, scratch):
    m = events_mart(spark, SF_SMALL).live()
    mm = materialize(m, scratch + "/marts")
    assert "order_date__day" in mm.orders.columns and "session_date__day" in mm.sessions.columns
    for fn in (sales.sales_timeseries, act.dau_daily, ops.ops_timeseries, act.dau_by_dim, act.activation_7d,
               sales.kpi_summary):
        assert _rows(fn(mm, P1)) == _rows(fn(m, P1))
    act_plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(
        act.activation_7d(mm, P1)._jdf.queryExecution(), "formatted")
    assert "/orders" not in act_plan  # first order day comes from the users table
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(
        act.dau_daily(mm, P1)._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(session_date__day" in plan
