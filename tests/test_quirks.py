"""Hand-made micro-tables (FIXTURES.md §4) with hand-computed expectations for the kept quirks."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from pulse.functions.filters import Dim, FilterSpec
from pulse.operators import acquisition as acq
from pulse.operators import activation as act
from pulse.operators import operations as ops
from pulse.operators import sales
from pulse.sources.marts import Marts

D1, D2 = date(2024, 3, 1), date(2024, 3, 10)
F0 = FilterSpec(D1, D2)


@pytest.fixture(scope="module")
def m(spark):
    users = spark.createDataFrame([
        (1, "X", "C1", "ios", datetime(2024, 3, 1, 0, 0, 0)),
        (2, "X", "C1", "web", datetime(2024, 3, 10, 23, 59, 59, 999999)),
        (3, None, "C2", "ios", datetime(2024, 3, 5, 12, 0, 0)),
        (4, "Y", "C2", "android", datetime(2024, 2, 20, 8, 0, 0)),
        (5, "Y", "C1", "ios", datetime(2024, 3, 15, 8, 0, 0)),
        (6, "Y", "C1", "web", datetime(2024, 3, 3, 8, 0, 0)),
    ], "user_id long, city string, acquisition_channel string, device string, created_at timestamp_ntz")
    sessions = spark.createDataFrame([
        (1, datetime(2024, 3, 2, 9)), (1, datetime(2024, 3, 2, 18)),
        (4, datetime(2024, 3, 2, 7)), (4, datetime(2024, 3, 5, 7)), (4, datetime(2024, 3, 9, 7)),
        (99, datetime(2024, 3, 2, 7)),
        (2, datetime(2024, 3, 31, 7)),
    ], "user_id long, session_date timestamp_ntz")
    orders = spark.createDataFrame([
        (1, 1, 1, datetime(2024, 3, 2, 10), "completed", Decimal("100.00"), Decimal("10.00"), None),
        (2, 1, 2, datetime(2024, 3, 2, 10), "cancelled", Decimal("50.00"), Decimal("5.00"), None),
        (3, 2, 999, datetime(2024, 3, 10, 12), "completed", Decimal("30.00"), Decimal("3.00"), None),
        (4, 6, 3, datetime(2024, 2, 1, 12), "completed", Decimal("20.00"), Decimal("2.00"), None),
        (5, 4, 3, datetime(2024, 3, 5, 12), "pending", Decimal("40.00"), Decimal("4.00"), None),
        (6, 3, 1, datetime(2024, 3, 6, 12), "completed", Decimal("10.00"), Decimal("1.00"), datetime(2024, 3, 7)),
    ], "order_id long, user_id long, vendor_id long, order_date timestamp_ntz, order_status string, "
       "order_total decimal(18,2), commission decimal(18,2), deleted_at timestamp_ntz")
    vendors = spark.createDataFrame([(1, "K", "A", 4.0), (2, "K", "A", 3.0), (3, "L", "B", 5.0)],
                                    "vendor_id long, city string, category string, rating double")
    return Marts(users, sessions, orders, vendors).live()


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_empty_list_means_no_filter_and_null_city_drops(m):
    r = one(acq.users_base_vs_new(m, F0))
    assert (r["base_before"], r["new_in_range"], r["total_all"]) == (1, 4, 6)
    r = one(acq.users_base_vs_new(m, F0.replace(cities=("X", "Y"))))
    assert r["new_in_range"] == 3  # u3 has a NULL city


def test_range_bounds_are_inclusive_days(m):
    days = {r["day"]: r["new_users"] for r in acq.new_users_daily(m, F0).collect()}
    assert len(days) == 10
    assert days[date(2024, 3, 1)] == 1 and days[date(2024, 3, 10)] == 1


def test_dau_average_over_active_days_and_unknown_users(m):
    dau = {r["day"]: r["dau"] for r in act.dau_daily(m, F0).collect()}
    assert dau == {date(2024, 3, 2): 2, date(2024, 3, 5): 1, date(2024, 3, 9): 1}
    assert one(act.dau_7d_avg(m, F0))["dau_7d_avg"] == pytest.approx(4 / 3)


def test_mau_uses_whole_month_of_d2(m):
    assert one(act.mau(m, F0))["mau"] == 3  # includes u2's session on 03-31


def test_activation_counts_orders_before_signup(m):
    assert one(act.activation_7d(m, F0))["activation_7d"] == pytest.approx(0.75)


def test_kpi_inner_vendor_join_and_status_filter(m):
    spec = F0.replace(statuses=("completed", "cancelled"))
    r = one(sales.orders_kpis(m, spec))
    assert (r["orders_total"], r["orders_completed"], r["orders_cancelled"]) == (2, 1, 1)
    assert r["gmv"] == 100.0 and r["commission"] == 10.0 and r["aov"] == 100.0 and r["cancel_rate"] == 0.5


def test_ops_left_vendor_join_no_status_filter(m):
    ts = {r["day"]: (r["orders_total"], r["orders_completed"], r["orders_cancelled"])
          for r in ops.ops_timeseries(m, F0.replace(statuses=("completed",))).collect()}
    assert ts == {date(2024, 3, 2): (2, 1, 1), date(2024, 3, 5): (1, 0, 0), date(2024, 3, 10): (1, 1, 0)}
    ts = {r["day"]: r["orders_total"] for r in ops.ops_timeseries(m, F0.replace(categories=("A",))).collect()}
    assert ts == {date(2024, 3, 2): 2}


def test_first_order_tie_and_missing_vendor(m):
    tags = {r["user_id"]: (r["fo_category"], r["fo_status"]) for r in acq.first_order_tags(m, F0).collect()}
    assert tags[1] == ("A", "completed")  # same instant: smaller order_id wins
    assert tags[2] == (None, "completed")  # vendor missing -> no category
    assert 6 not in tags                   # only order is before the range
    spec = F0.replace(categories=("A", "B", "Sin compra"), series_dim=Dim.CATEGORY)
    tot = {(r["day"], r["series"]): r["value"] for r in acq.new_users_by_first_order_dim(m, spec).collect()}
    assert tot[(date(2024, 3, 10), "Sin compra")] == 1
    assert tot[(date(2024, 3, 1), "A")] == 1
    assert sum(v for (d, s), v in tot.items() if s == "Total") == 4


def test_active_by_first_order_drops_sin_compra_with_lists(m):
    res = {r["dim"]: r["active_users"] for r in act.active_users_by_first_order_dim(m, F0, Dim.CATEGORY).collect()}
    assert res == {"A": 1, "B": 1}
    spec = F0.replace(categories=("A", "B"), statuses=("completed", "cancelled"))
    res = {r["dim"]: r["active_users"] for r in act.active_users_by_first_order_dim(m, spec, Dim.CATEGORY).collect()}
    assert res == {"A": 1}


def test_bins_keep_or_drop_empty(m):
    res = {r["day"]: r["value"] for r in act.active_users_by_bins(m, F0, date(2024, 2, 20), D2, 7).collect()}
    assert res == {date(2024, 2, 20): 0, date(2024, 2, 27): 3, date(2024, 3, 5): 1}
    spec = F0.replace(cities=("X", "Y"))
    res = {r["day"]: r["value"] for r in act.active_users_by_bins(m, spec, date(2024, 2, 20), D2, 7).collect()}
    assert res == {date(2024, 2, 27): 2, date(2024, 3, 5): 1}


def test_dau_by_dim_dense_with_unknown(m):
    spec = F0.replace(series_dim=Dim.CITY)
    rows = act.dau_by_dim(m, spec).collect()
    series = {r["series"] for r in rows}
    assert series == {"Total", "X", "Y"}
    assert len(rows) == 10 * 3


def test_previous_window_and_cross_filter():
    spec = FilterSpec(date(2024, 1, 8), date(2024, 1, 21), cities=("A", "B"))
    assert spec.previous_window() == (date(2023, 12, 25), date(2024, 1, 7))
    assert spec.cross_filter(Dim.CITY, ["B", "C"]).cities == ("B",)
    assert spec.cross_filter(Dim.CITY, ["C"]).cities == ()        # empty intersection removes the filter
    assert FilterSpec(D1, D2).cross_filter(Dim.CITY, ["C"]).cities == ("C",)


def test_delta_pct_rule(spark):
    from pulse.functions.columns import delta_pct
    df = spark.createDataFrame([(5, 0), (0, 0), (6, 3)], "cur long, prev long")
    assert [r[0] for r in df.select(delta_pct("cur", "prev")).collect()] == [1.0, 0.0, 1.0]


def test_share_top8_others(spark):
    from pulse.operators.shares import share_top_n_others
    df = spark.createDataFrame([(f"s{i}", 10 - i) for i in range(10)], "series string, v long")
    rows = {r["series"]: (r["share"], r["value"]) for r in share_top_n_others(df, "v", "series", 8).collect()}
    assert len(rows) == 9 and rows["Otros"][1] == 3.0  # s8 (2) + s9 (1)
    assert sum(s for s, _ in rows.values()) == pytest.approx(1.0)


def test_filter_in_ignores_empty_and_missing(spark):
    from pulse.functions.filters import filter_in
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x")], "city string, segment string")
    assert filter_in(df, {"city": [], "segment": ["x"], "plan_type": ["pro"]}).count() == 2
    assert filter_in(df, {"city": ["a"]}).count() == 1
