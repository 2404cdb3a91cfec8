"""Day bitmaps, interval joins, features at many dates and grouping sets: against plain Python, and their plans."""

import random
import re
from datetime import date, datetime, timedelta

import pytest


from pulse.functions.filters import FilterSpec
from pulse.operators import activity_bitmaps as bits
from pulse.operators import cube, intervals
from pulse.operators.churn.features import churn_features, churn_history
from pulse.plans.catalog import load_all
from pulse.sources.marts import Marts
from pulse.sources.tables import Tables

from conftest import SF_SMALL

REG = load_all()
D0 = date(2024, 3, 1)
EVERYONE = FilterSpec(D0, D0 + timedelta(days=40))


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def scans(text: str, table: str) -> int:
    return len(re.findall(rf"Location: \S+ \[[^\]]*{table}\.parquet", text))


@pytest.fixture(scope="module")
def world(spark):
    """Users with sparse ids, one of whom has a third of all sessions."""
    r = random.Random(5)
    users = [(u, r.choice(["X", "Y", None]), r.choice(["C", "D"]), r.choice(["ios", "web"]), datetime(2024, 2, 1)) for u in (*range(0, 300, 3), 40_000, 70_001, 10**7)]
    ids = [u[0] for u in users]
    seen = [(ids[3] if i % 3 == 0 else r.choice([*ids, 999_999]), datetime(2024, 3, 1) + timedelta(minutes=r.randrange(40 * 1440))) for i in range(3000)]
    m = Marts(spark.createDataFrame(users, "user_id long, city string, acquisition_channel string, device string, created_at timestamp_ntz"),
              spark.createDataFrame(seen, "user_id long, session_date timestamp_ntz"), None, None)
    return m, {u[0]: u for u in users}, seen


def brute(users, seen, inside):
    out = {}
    for u, t in seen:
        if u in users and inside(t.date()):
            for dim, series in (("total", "Total"), ("city", users[u][1] or "UNKNOWN"), ("channel", users[u][2]), ("device", users[u][3])):
                out.setdefault((dim, series), set()).add(u)
    return {k: len(v) for k, v in out.items()}


def test_any_range_from_the_bitmaps_alone(spark, world, scratch):
    m, users, seen = world
    kept = bits.write_bitmaps(bits.day_bitmaps(m, EVERYONE, D0, D0 + timedelta(days=40)), scratch + "/bitmaps")
    assert "LocalTableScan" not in plan(bits.active_between(kept, D0, D0))  # the sessions of this test are a local table
    for a, b in ((0, 0), (0, 40), (3, 9), (17, 30), (39, 60), (50, 51)):
        d1, d2 = D0 + timedelta(days=a), D0 + timedelta(days=b)
        got = {(r["dim"], r["series"]): r["active_users"] for r in bits.active_between(kept, d1, d2).collect()}
        assert got == brute(users, seen, lambda d: d1 <= d <= d2)  # noqa: B023
    by = {}
    for r in bits.active_by_grain(kept, D0, D0 + timedelta(days=40)).collect():
        by.setdefault((r["grain"], r["period"]), {})[(r["dim"], r["series"])] = r["active_users"]
    assert by["day", date(2024, 3, 5)] == brute(users, seen, lambda d: d == date(2024, 3, 5))
    assert by["trailing", date(2024, 3, 7)] == brute(users, seen, lambda d: date(2024, 3, 1) <= d <= date(2024, 3, 7))
    assert by["month", date(2024, 3, 1)] == brute(users, seen, lambda d: d.month == 3)
    assert ("trailing", date(2024, 3, 6)) not in by


def test_days_written_again_replace_theirs(spark, world, scratch):
    m, users, seen = world
    path = scratch + "/bitmaps"
    bits.write_bitmaps(bits.day_bitmaps(m, EVERYONE, D0, D0 + timedelta(days=9)), path)
    kept = bits.write_bitmaps(bits.day_bitmaps(m, EVERYONE, D0 + timedelta(days=5), D0 + timedelta(days=12)), path)
    got = {(r["dim"], r["series"]): r["active_users"] for r in bits.active_between(kept, D0, D0 + timedelta(days=12)).collect()}
    assert got == brute(users, seen, lambda d: D0 <= d <= D0 + timedelta(days=12))


SPANS = [("all", date(1000, 1, 1), date(3000, 1, 1)), ("one", D0, D0), ("inverted", D0 + timedelta(days=3), D0), ("none", None, D0), ("open", D0, None),
         *[(f"s{i}", D0 + timedelta(days=i % 11), D0 + timedelta(days=i % 11 + 3**(i % 6))) for i in range(30)], ("old", date(1960, 1, 1), date(1969, 12, 31))]


@pytest.mark.parametrize("salts", [1, 4])
def test_interval_join_equals_brute_force_without_a_nested_loop(spark, salts):
    r = random.Random(salts)
    facts = [(i, D0 if i % 3 == 0 else None if i % 50 == 1 else date(1959, 12, 20) + timedelta(days=r.randrange(24_000))) for i in range(600)]  # a hot day
    f = spark.createDataFrame(facts, "id int, day date")
    s = spark.createDataFrame(SPANS, "id string, a date, b date")  # a column of the same name
    want = sorted((i, n) for i, d in facts for n, a, b in SPANS if d and a and b and a <= d <= b)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            met = intervals.interval_join(f, "day", s, "a", "b", salts)
            assert "NestedLoop" not in plan(met) and "Cartesian" not in plan(met)
            assert sorted((x[0], x[2]) for x in met.collect()) == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_interval_over_everything_costs_few_rows(spark):
    s = spark.createDataFrame([("all", date(1, 1, 1), date(9999, 12, 31)), ("day", D0, D0)], "id string, a date, b date")
    f = spark.createDataFrame([(1, D0)], "id int, day date")
    met = intervals.interval_join(f, "day", s, "a", "b")
    assert met.count() == 2
    first = (date(9999, 12, 31) - date(1, 1, 1)).days + 1
    level = next(i for i in range(intervals.LEVELS) if first <= intervals.GRID * intervals.FAN ** (i + 1) or i == intervals.LEVELS - 1)
    assert first / (intervals.GRID * intervals.FAN**level) <= intervals.FAN + 1


def test_history_reads_each_fact_once_and_agrees_with_single_dates(spark):
    t = Tables(spark, SF_SMALL)
    dates = [(date(1999, m, 1), date(2024, 1, 10 + m)) for m in range(1, 13)]
    df = churn_history(t, dates)
    text = plan(df)
    assert [scans(text, x) for x in ("orders", "lineitem", "events", "customer")] == [1, 1, 1, 1]
    got = {(r["as_of"], r["customer_id"]): r for r in df.collect()}
    for as_of, ev in (dates[0], dates[6], dates[11]):
        for r in churn_features(t, as_of, 90, 90, 30, events_as_of=ev).collect():
            g = got[as_of, r["customer_id"]]
            for mine, theirs in (("tx_30d", "tx_30d"), ("tx_90d", "tx_90d"), ("revenue_90d", "revenue_365d"), ("aov_90d", "aov_365d"), ("events_7d", "events_7d"),
                                 ("events_30d", "events_30d"), ("days_since_last_tx", "days_since_last_tx"), ("avg_discount_90d", "avg_discount_365d"),
                                 ("churn", "churn"), ("city", "city"), ("segment", "segment"), ("plan_type", "plan_type"), ("has_mobile_app", "has_mobile_app")):
                assert g[mine] == r[theirs], (mine, g, r)
    assert len(got) == 12 * t.customer.count()


@pytest.mark.parametrize("name,table,times", [("orders_cube", "events", 1), ("new_users_cube", "customer", 1), ("active_users_cube", "events", 1), ("dau_with_totals", "events", 1)])
def test_cubes_read_their_fact_once(spark, name, table, times):
    assert scans(plan(REG[name].run(spark, SF_SMALL)), table) == times


def test_cube_keeps_missing_values_apart_from_totals(spark, world):
    m, users, seen = world
    got = {(r["city"], r["channel"], r["device"]): (r["active_users"], r["user_days"]) for r in cube.active_users_cube(m, EVERYONE).collect()}
    pairs = {(u, t.date()) for u, t in seen if u in users and D0 <= t.date() <= EVERYONE.date_to}
    for key in {(c, h, v) for c in ("X", "Y", "UNKNOWN", "Total") for h in ("C", "D", "Total") for v in ("ios", "web", "Total")}:
        fits = [p for p in pairs if all(k in ("Total", x or "UNKNOWN") for k, x in zip(key, users[p[0]][1:4], strict=True))]
        assert got.get(key, (0, 0)) == (len({u for u, _ in fits}), len(fits))


def test_campaign_query_has_no_nested_loop(spark):
    text = plan(REG["active_users_by_campaign"].run(spark, SF_SMALL))
    assert "NestedLoop" not in text
