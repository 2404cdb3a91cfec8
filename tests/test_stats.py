"""Exact order statistics by window narrowing vs numpy, with narrowing forced (small cap)."""

import numpy as np
import pytest

from pulse.functions import stats


@pytest.mark.parametrize("cap", [50, 1_000_000])
def test_order_statistics_match_numpy(spark, monkeypatch, cap):
    monkeypatch.setattr(stats, "CAP", cap)
    rng = np.random.default_rng(7)
    a = np.round(rng.normal(size=3000), 2)          # many ties
    b = rng.integers(0, 5, size=2000).astype(float)  # heavy ties
    c = np.full(500, 3.25)                           # constant group
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("c", float(x)) for x in c]
    df = spark.createDataFrame(rows, "g string, x double")
    ranks = {"a": [1, 1500, 1501, 3000], "b": [1, 1000, 2000], "c": [1, 250]}
    got = {(r["g"], r["k"]): r["x"] for r in stats.order_statistics(df, "g", "x", ranks).collect()}
    for g, arr in (("a", a), ("b", b), ("c", c)):
        s = np.sort(arr)
        for k in ranks[g]:
            assert got[(g, k)] == s[k - 1]


def test_medians_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(stats, "CAP", 40)
    rng = np.random.default_rng(3)
    x = rng.exponential(size=801)
    y = rng.integers(0, 9, size=800).astype(float)
    df = spark.createDataFrame([(float(x[i]), float(y[i]) if i < 800 else None) for i in range(801)],
                               "x double, y double")
    med = {r["feature"]: r["median"] for r in stats.medians(df, ["x", "y"]).collect()}
    assert med["x"] == np.median(x)
    assert med["y"] == np.median(y)


@pytest.mark.parametrize("cap", [30, 1_000_000])
def test_order_statistics_with_tiebreak(spark, monkeypatch, cap):
    monkeypatch.setattr(stats, "CAP", cap)
    rng = np.random.default_rng(5)
    vals = rng.integers(0, 4, size=600)             # heavy ties on the value
    ids = rng.permutation(600)
    rows = [("g", int(v), int(i)) for v, i in zip(vals, ids)] + [("c", 7, int(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, x long, id long")
    ranks = {"g": [1, 123, 300, 600], "c": [1, 17]}
    got = {(r["g"], r["k"]): (r["x"], r["id"]) for r in
           stats.order_statistics(df, "g", "x", ranks, tiebreak_col="id").collect()}
    order = sorted((int(v), int(i)) for v, i in zip(vals, ids))
    for k in ranks["g"]:
        assert got[("g", k)] == order[k - 1]
    assert got[("c", 17)] == (7, 16)


@pytest.mark.parametrize("values", [[0.0, 1.0], list(map(float, range(10)))])
def test_heavy_ties_leave_no_large_window(spark, values):
    rng = np.random.default_rng(1)
    x = rng.choice(values, size=4000)
    df = spark.createDataFrame([("g", float(v)) for v in x], "_g string, _x double")
    ranks = [1, 2000, 2001, 4000]
    targets = [stats.Target("g", k) for k in ranks]
    stats.narrow(df, targets, cap=100)
    assert all(t.answer is not None or t.rows <= 100 for t in targets)
    stats._rank_small(df, targets)
    s = np.sort(x)
    assert [t.answer for t in targets] == [s[k - 1] for k in ranks]
    assert [t.before for t in targets] == [int((s < s[k - 1]).sum()) for k in ranks]


def test_fifty_fifty_column(spark, monkeypatch):
    monkeypatch.setattr(stats, "CAP", 100)
    df = spark.range(4000).selectExpr("cast(id % 2 as double) AS x")
    assert stats.medians(df, ["x"]).first()["median"] == 0.5
