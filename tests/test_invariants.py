
from collections import defaultdict
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pulse.functions.filters import Dim, FilterSpec
from pulse.operators import acquisition as acq
from pulse.operators import activation as act
from pulse.operators import operations as ops
from pulse.operators import sales
from pulse.plans.params import SEGMENTS
from pulse.sources.marts import events_mart

from conftest import SF_SMALL

specs = st.builds(
    lambda start, length, cities: FilterSpec(date(2024, 1, 1) + timedelta(days=start),
                                             date(2024, 1, 1) + timedelta(days=start + length - 1),
                                             cities=tuple(cities), series_dim=Dim.CITY),
    st.integers(0, 25), st.integers(1, 9), st.lists(st.sampled_from(SEGMENTS), unique=True, max_size=3))

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def m(spark):
    return events_mart(spark, SF_SMALL).live()


@SETTINGS
@given(spec=specs)
def test_dense_breakdowns(m, spec):
    dim, vals = spec.series_values()
    rows = acq.new_users_by_dim_selected_total(m, spec).collect()
    n_series = len(vals) + 1 if vals else 1
    assert len(rows) == spec.days * n_series
    per_day = defaultdict(int)
    total = {}
    for r in rows:
        if r["series"] == "Total":
            total[r["day"]] = r["value"]
        else:
            per_day[r["day"]] += r["value"]
    if vals:
        assert all(total[d] == per_day[d] for d in total)
    dau = act.dau_by_dim(m, spec).collect()
    series = {r["series"] for r in dau}
    assert len(dau) == spec.days * len(series)
    tot = defaultdict(int)
    parts = defaultdict(int)
    for r in dau:
        (tot if r["series"] == "Total" else parts)[r["day"]] += r["value"]
    assert all(tot[d] <= parts[d] for d in tot if parts)


@SETTINGS
@given(spec=specs)
def test_counts_and_shares(m, spec):
    k = sales.orders_kpis(m, spec).first()
    assert k["orders_completed"] + k["orders_cancelled"] <= k["orders_total"]
    shares = [r["share"] for r in ops.ops_share_metric(m, spec, "total", Dim.CITY).collect()]
    assert not shares or sum(shares) == pytest.approx(1.0)
    s = [r["share"] for r in acq.new_users_share(m, spec).collect()]
    assert not s or sum(s) == pytest.approx(1.0)


@SETTINGS
@given(spec=specs, period=st.integers(1, 8))
def test_bins_on_period_grid(m, spec, period):
    start = spec.date_from - timedelta(days=3 * period)
    for r in act.active_users_by_bins(m, spec, start, spec.date_to, period).collect():
        assert (r["day"] - start).days % period == 0 and start <= r["day"] <= spec.date_to
        assert r["value"] >= 0


@given(spec=specs)
def test_previous_window_adjacent_equal_length(spec):
    p1, p2 = spec.previous_window()
    assert p2 == spec.date_from - timedelta(days=1)
    assert (p2 - p1).days + 1 == spec.days
