"""Period-bar index shift (quirk Q9) and the top-table normaliser's resolution rules."""

from datetime import date


def test_period_bars_index_from_first_surviving_day(spark):
    from pulse.operators.acquisition import period_bars
    # bins of 7 days starting 01-01; the first two bins were dropped upstream
    df = spark.createDataFrame([(date(2024, 1, 15), 4), (date(2024, 1, 22), 6)], "day date, value long")
    rows = {r["period_idx"]: (r["label"], r["value"], r["selected"]) for r in period_bars(df, 7, 2).collect()}
    assert rows == {0: ("01-15→01-21", 4, False), 1: ("01-22→01-28", 6, False)}  # index 2 no longer exists


def test_normalize_top_rules(spark):
    from pulse.operators.shares import normalize_top
    a = spark.createDataFrame([("x", "12.5", "3"), (None, "bad", None)], "vendor_name string, sales string, order_count string")
    rows = sorted(tuple(r) for r in normalize_top(a).collect())
    assert rows == [("None", 0.0, 0), ("x", 12.5, 3)]           # priority list, aliases, coercion to 0
    b = spark.createDataFrame([("c1", "k", 2.0, 5)], "city string, category string, gmv double, orders long")
    assert normalize_top(b, preferred_dim_col="category").first()["dim"] == "k"
    assert normalize_top(b).first()["dim"] == "c1"              # 'city' precedes 'category'
