"""Schema resolver rules, table finder, CSV sink, alert snapshots."""

from datetime import date, datetime

from pulse.functions.filters import Dim, FilterSpec
from pulse.sources import resolver
from pulse.sources.marts import Marts


def test_pick_existing_col_priority(spark):
    df = spark.createDataFrame([], "order_date timestamp, created_at timestamp, order_status string, status string")
    assert resolver.pick_existing_col(df, resolver.CANDIDATES["orders"]["at"]) == "created_at"
    assert resolver.pick_existing_col(df, resolver.CANDIDATES["orders"]["status"]) == "status"
    assert resolver.pick_existing_col(df, ["nope"]) is None


def test_find_table_by_columns(spark):
    t = {("public", "orders"): spark.createDataFrame([], "order_id long, user_id long"),
         ("mp", "orders2"): spark.createDataFrame([], "order_id long, user_id long, x int"),
         ("mp", "users"): spark.createDataFrame([], "user_id long")}
    meta = resolver.catalog_frame(spark, t)
    r = resolver.find_table_by_columns(meta, ["orders"], ["order_id", "user_id"]).first()
    assert (r["table_schema"], r["table_name"]) == ("public", "orders")
    r = resolver.find_table_by_columns(meta, [], ["order_id", "user_id"]).first()
    assert (r["table_schema"], r["table_name"]) == ("mp", "orders2")
    assert resolver.find_table_by_columns(meta, [], ["zzz"]).count() == 0


def test_degraded_schemas(spark):
    from pulse.operators import operations as ops
    from pulse.operators import sales
    users = spark.createDataFrame([(1, "X")], "id long, ciudad string")
    orders = spark.createDataFrame([(1, datetime(2024, 1, 2), 5.0, 7)],
                                   "customer_id long, created_at timestamp_ntz, amount double, store_id long")
    m = Marts(users, users.limit(0), orders, None)
    spec = FilterSpec(date(2024, 1, 1), date(2024, 1, 3), cities=("X",))
    r = ops.ops_timeseries(m, spec).first()
    assert (r["orders_total"], r["orders_completed"], r["orders_cancelled"]) == (1, 0, 0)  # no status column
    r = sales.top10_gmv_by_dim(m, spec, Dim.CATEGORY).first()
    assert (r["dim"], r["gmv"], r["orders"]) == ("UNKNOWN", 5.0, 1)  # no vendors, GMV = all orders
    no_user = spark.createDataFrame([(datetime(2024, 1, 2),)], "created_at timestamp_ntz")
    assert ops.ops_timeseries(Marts(users, users.limit(0), no_user, None), spec).count() == 0


def test_csv_latin1_roundtrip(spark, scratch):
    from pulse.sources.sinks import write_csv
    from pulse.sources.tables import read_csv
    from pyspark.sql import types as T
    df = spark.createDataFrame([("Querétaro", 1.5)], "city string, v double")
    write_csv(df, scratch + "/out", single_file=True)
    back = read_csv(spark, scratch + "/out", T.StructType([T.StructField("city", T.StringType()),
                                                             T.StructField("v", T.DoubleType())]),
                    encoding="ISO-8859-1")
    assert back.first()["city"] == "Querétaro"


def test_alert_snapshots(spark, scratch):
    from pulse.sources.sinks import append_alert_snapshot, latest_two_runs, read_alert_snapshots
    schema = "customer_id long, city string, segment string, plan_type string, churn_probability double, run_ts timestamp_ntz"
    for ts, p in ((datetime(2026, 2, 1, 10), 0.9), (datetime(2026, 2, 16, 20), 0.8)):
        append_alert_snapshot(spark.createDataFrame([(1, "A", "low", "basic", p, ts)], schema), scratch + "/alerts")
    cur, prev = latest_two_runs(read_alert_snapshots(spark, scratch + "/alerts"))
    assert cur.first()["churn_probability"] == 0.8 and prev.first()["churn_probability"] == 0.9
