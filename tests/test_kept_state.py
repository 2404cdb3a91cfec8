"""Runs, rollups and sketches: state that is written, merged and read back."""

import os
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pulse.operators import rollups
from pulse.operators import sketches as sk
from pulse.operators.churn import runs
from pulse.sources.runs import RunStore

T0 = datetime(2024, 5, 1, 6)


def scores(spark, *p):
    return spark.createDataFrame([(i, "mid", x) for i, x in enumerate(p)], "customer_id long, segment string, churn_probability double")


def counts(df):
    return {r["metric"]: (r["current"], r["previous"]) for r in df.collect()}["count"]


def test_the_latest_two_complete_runs_are_compared(spark, scratch):
    store = RunStore(spark, scratch + "/runs")
    assert store.runs() == []
    with pytest.raises(LookupError):
        runs.compare_latest(store)
    runs.record_scores(store, "a", T0, scores(spark, .1, .2, .3), {"segment": ["mid"]}, {"roc_auc": 0.7})
    assert counts(runs.compare_latest(store)) == (3, None)
    runs.record_scores(store, "b", T0 + timedelta(days=1), scores(spark, .5), {})
    runs.record_scores(store, "c", T0 + timedelta(days=2), scores(spark, .5, .6), {"segment": ["low", "mid"]})
    out = runs.compare_latest(store)
    row = out.first()
    assert counts(out) == (2, 1) and (row["current_run"], row["previous_run"]) == ("c", "b")
    assert (row["current_filters"], row["previous_filters"]) == ("segment=low,mid", "")
    assert counts(runs.compare_latest(store, T0 + timedelta(days=1, hours=1))) == (1, 3)
    assert store.latest(1, T0)[0].info == {"filters": {"segment": ["mid"]}, "metrics": {"roc_auc": 0.7}}


def test_a_run_that_died_half_way_is_never_seen(spark, scratch, monkeypatch):
    store = RunStore(spark, scratch + "/runs")
    runs.record_scores(store, "a", T0, scores(spark, .1), {})
    with monkeypatch.context() as m:
        m.setattr(RunStore, "_publish", lambda self, run: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            runs.record_scores(store, "b", T0 + timedelta(days=1), scores(spark, .5, .6), {})
    bad = scores(spark, .5).withColumn("churn_probability", F.expr("if(customer_id >= 0, raise_error('executor'), 0.1)").cast("double"))
    with pytest.raises(Exception, match="executor"):
        store.write("c", T0 + timedelta(days=2), {"scores": bad})
    assert os.path.isdir(scratch + "/runs/data/b") and [r.run_id for r in store.runs()] == ["a"]
    runs.record_scores(store, "b", T0 + timedelta(days=1), scores(spark, .5, .6), {})  # run again
    assert [r.run_id for r in store.runs()] == ["b", "a"] and counts(runs.compare_latest(store)) == (2, 1)


def test_a_rerun_replaces_its_run_and_old_readers_go_on(spark, scratch):
    store = RunStore(spark, scratch + "/runs")
    old = runs.record_scores(store, "a", T0, scores(spark, .1), {})
    reading = store.frame(old, "scores")
    runs.record_scores(store, "a", T0, scores(spark, .1, .9), {})
    assert [r.frames["scores"]["rows"] for r in store.runs()] == [2]
    assert reading.count() == 1 and store.frame(store.runs()[0], "scores").count() == 2
    for name in ("../a", "", ".hidden", "a b"):
        with pytest.raises(ValueError):
            store.write(name, T0, {})


def test_retraining_remembers_filters_metrics_and_scores(spark, scratch):
    df = spark.range(400).selectExpr("id as customer_id", "if(id % 3 = 0, 'low', 'mid') as segment", "id % 17 * 1.0D as x", "cast(id % 17 > 8 as int) as churn")
    kw = {"num_cols": ["x"], "cat_cols": ["segment"], "label_col": "churn", "id_col": "customer_id", "num_trees": 4, "max_depth": 3}
    store = RunStore(spark, scratch + "/runs")
    runs.retrain_run(store, "first", T0, df, {}, **kw)
    model, run = runs.retrain_run(store, "second", T0 + timedelta(days=1), df, {"segment": ["mid"]}, **kw)
    assert run.info["filters"] == {"segment": ["mid"]} and run.info["metrics"] == model.metrics
    n = df.where("segment = 'mid'").count()
    assert counts(runs.compare_latest(store)) == (n, 400) and run.frames["scores"]["rows"] == n


ORDERS = "order_id long, user_id long, vendor_id long, order_date timestamp_ntz, order_status string, order_total decimal(18,2), commission decimal(18,2)"
CHANGES = ORDERS + ", deleted boolean, changed_at timestamp_ntz"


def order(i, day, status="completed", total="10.00"):
    return i, i % 7, None, datetime(2024, 5, day, i % 24), status, Decimal(total), Decimal("1.00")


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.startswith("part-")) for d in os.listdir(path) if d.startswith("day=")}


def test_rollup_after_a_batch_equals_a_rebuild_and_leaves_other_days_alone(spark, scratch):
    path, again = scratch + "/rollup", scratch + "/rebuilt"
    orders = spark.createDataFrame([order(i, 1 + i % 10) for i in range(200)] + [order(900, 20)], ORDERS)
    rollups.build(orders, path)
    before = files(path)
    at = datetime(2024, 6, 1)
    later = at + timedelta(hours=1)
    changes = spark.createDataFrame([
        (*order(3, 4, "cancelled"), False, at), (*order(3, 6, "completed", "99.00"), False, later),  # changed twice, moved from day 4 to 6
        (*order(900, 20), True, at), (*order(13, 4), True, later), (*order(13, 4), False, later),  # a day emptied; deletion wins a tie
        (*order(5000, 25), False, at)], CHANGES)  # late, on a new day
    days = rollups.apply_changes(orders, changes, path)
    assert [d.day for d in days] == [4, 6, 20, 25]
    after = files(path)
    assert {d: f for d, f in after.items() if d[-2:] not in ("04", "06", "20", "25")} == {d: f for d, f in before.items() if d[-2:] not in ("04", "06", "20")}
    assert all(after[d] != before[d] for d in before if d[-2:] in ("04", "06", "20"))
    rollups.build(rollups.merged(orders, changes), again)
    got, want = (sorted(tuple(r) for r in rollups.read(spark, p).collect()) for p in (path, again))
    assert got == want and len(got) == 11
    assert rollups.apply_changes(orders, changes.where("false"), path) == []


def test_rollup_reads_only_the_touched_days_of_a_partitioned_table(spark, scratch):
    orders = spark.createDataFrame([order(i, 1 + i % 10) for i in range(100)], ORDERS).withColumn("order_date__day", F.to_date("order_date"))
    orders.write.partitionBy("order_date__day").parquet(scratch + "/orders")
    stored = spark.read.parquet(scratch + "/orders")
    rollups.build(stored, scratch + "/rollup")
    changes = spark.createDataFrame([(*order(3, 4, "cancelled"), False, T0)], CHANGES)
    assert [d.day for d in rollups.apply_changes(stored, changes, scratch + "/rollup")] == [4]
    r = {x["day"].day: x for x in rollups.read(spark, scratch + "/rollup").collect()}
    assert (r[4]["orders_cancelled"], r[4]["orders_total"], r[5]["orders_cancelled"]) == (1, 10, 0)


def test_distinct_users_of_merged_sketches_keep_their_error(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("id as user_id", "id % 10 as day", "explode(array('a', if(id % 3 = 0, 'b', 'a'))) as series").distinct()
    days = rows.groupBy("day", "series").agg(F.hll_sketch_agg("user_id", sk.HLL_LG_K).alias("users"))
    got = {r[0]: r[1] for r in days.groupBy("series").agg(F.hll_sketch_estimate(F.hll_union_agg("users"))).collect()}
    assert abs(got["a"] - n) <= 3 * sk.hll_error() * n and abs(got["b"] - n / 3) <= 3 * sk.hll_error() * n / 3
    assert got["a"] != n  # an estimate, not a count


def test_overlaps_of_large_windows_keep_their_error(spark):
    one, two = spark.range(0, 50_000), spark.range(30_000, 90_000)
    s = one.select(F.lit("one").alias("window"), "id").unionAll(two.select(F.lit("two"), "id"))
    s = s.groupBy("window", F.lit("total").alias("dim"), F.lit("Total").alias("series")).agg(F.theta_sketch_agg("id", sk.THETA_LG_K).alias("users"))
    r = sk.overlaps(s, "one", "two").first()
    bound = 3 / 2 ** (sk.THETA_LG_K / 2)
    assert abs(r["both"] - 20_000) <= bound * 90_000 and abs(r["users_one"] - 50_000) <= bound * 50_000


@pytest.mark.parametrize("k", [sk.KLL_K, 400])
def test_quantiles_of_merged_sketches_keep_their_rank_error(spark, k):
    n = 40_000
    scored = spark.range(n).selectExpr("if(id % 4 = 0, 'low', 'mid') as segment", "id % 8 as part", "if(id % 1000 = 0, null, sqrt((id * 7919) % 40009)) as p")
    cells = scored.where("p is not null").groupBy("segment", "part").agg(F.kll_sketch_agg_double("p", F.lit(k)).alias("scores"))
    found = spark.createDataFrame(sk.quantiles(cells, ["segment"], (0.01, 0.5, 0.99)).collect(), "segment string, q double, value double")
    ranks = sk.exact_ranks(scored, found, "segment", "p").collect()
    assert len(ranks) == 6
    for r in ranks:
        assert r["below"] / r["n"] <= r["q"] + 2 * sk.kll_rank_error(k) and r["up_to"] / r["n"] >= r["q"] - 2 * sk.kll_rank_error(k)
