"""Churn preprocessing and model properties (SQL parity is in test_oracle)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.operators.churn import metrics as cm
from pulse.operators.churn import prep
from pulse.operators.churn.features import CATEGORICAL, ID, LABEL, NUMERIC, churn_features
from pulse.sources.tables import Tables

from datetime import date


@pytest.fixture(scope="module")
def features(spark):
    sf = "/root/testdata/sf0.01"
    return churn_features(Tables(spark, sf), date(2000, 1, 1)).persist()


def test_split_exact_counts_and_deterministic(features):
    a = prep.stratified_split(features, ID, LABEL)
    counts = {(r[LABEL], r["is_test"]): r["count"] for r in a.groupBy(LABEL, "is_test").count().collect()}
    for lab in (0, 1):
        n = counts.get((lab, True), 0) + counts.get((lab, False), 0)
        assert counts.get((lab, True), 0) == math.floor(0.2 * n + 0.5)
    b = prep.stratified_split(features, ID, LABEL)
    assert sorted(r[ID] for r in a.filter("is_test").collect()) == sorted(r[ID] for r in b.filter("is_test").collect())


def test_impute_leaves_no_nulls(features):
    imp = prep.impute(features, NUMERIC, CATEGORICAL)
    nulls = imp.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in NUMERIC + CATEGORICAL]).first()
    assert all(v == 0 for v in nulls.asDict().values())


def test_metric_edge_cases(spark):
    one_class = spark.createDataFrame([(1, 0.2), (1, 0.9)], "churn int, churn_probability double")
    assert math.isnan(cm.roc_auc(one_class).first()["roc_auc"])
    assert math.isnan(cm.f1_at_half(one_class).first()["f1"])
    s = spark.createDataFrame([(0.1234,), (0.1236,), (0.5,), (0.5,), (None,)], "churn_probability double")
    r = cm.risk_distribution_stats(s).first()
    assert r["mode"] == 0.5 and r["count"] == 4 and r["median"] == (0.1236 + 0.5) / 2
    assert r["std"] == pytest.approx(np.std([0.1234, 0.1236, 0.5, 0.5], ddof=1))
    single = spark.createDataFrame([(0.7,)], "churn_probability double")
    assert cm.risk_distribution_stats(single).first()["std"] == 0.0
    empty = spark.createDataFrame([], "churn_probability double")
    assert cm.risk_distribution_stats(empty).count() == 0
    ties = spark.createDataFrame([(0.2,), (0.1,)], "churn_probability double")
    assert cm.risk_distribution_stats(ties).first()["mode"] == 0.1


def test_auc_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, size=400)
    p = np.round(np.clip(y * 0.3 + rng.random(400) * 0.7, 0, 1), 2)  # ties included
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "churn int, churn_probability double")
    ours = cm.roc_auc(df).first()["roc_auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="churn_probability", labelCol="churn",
                                       metricName="areaUnderROC")
    theirs = ev.evaluate(df.withColumn("churn", F.col("churn").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_forest_train_score_save_restore(spark, features, scratch):
    from pulse.operators.churn import model as mm
    m = mm.train_forest(features, NUMERIC, CATEGORICAL, LABEL, ID, num_trees=10, max_depth=4)
    assert 0.0 <= m.metrics["roc_auc"] <= 1.0 and m.metrics["n_test"] > 0
    sc = mm.score(m, features)
    agg = sc.agg(F.min("churn_probability"), F.max("churn_probability"), F.count(F.lit(1))).first()
    assert 0.0 <= agg[0] <= agg[1] <= 1.0 and agg[2] == features.count()
    # unseen category: scores without error (encodes as all zeros)
    odd = features.limit(3).withColumn("segment", F.lit("never-seen"))
    assert mm.score(m, odd).count() == 3
    # same seed, same model
    m2 = mm.train_forest(features, NUMERIC, CATEGORICAL, LABEL, ID, num_trees=10, max_depth=4)
    assert m2.metrics == m.metrics
    base = scratch + "/models"
    mm.save_model(m, base)
    m3 = mm.train_forest(features, NUMERIC, ["city"], LABEL, ID, num_trees=5, max_depth=3)
    mm.save_model(m3, base)
    assert mm.load_model(base).cat_cols == ["city"]
    assert mm.restore_original(base).cat_cols == CATEGORICAL
    assert mm.load_model(base).cat_cols == CATEGORICAL


def test_histogram_nice_step(spark):
    df = spark.createDataFrame([(x / 100,) for x in range(101)], "churn_probability double")
    rows = cm.risk_histogram(df).collect()
    steps = {round(r["bin_end"] - r["bin_start"], 12) for r in rows}
    assert steps == {0.05} and sum(r["customers"] for r in rows) == 101


def test_churn_report_and_params(spark, features):
    from pulse.functions.filters import Dim, FilterSpec
    from pulse.plans.reports import churn_report
    rep = churn_report(features, {"segment": ["mid", "high"]}, NUMERIC, CATEGORICAL, LABEL, ID,
                       num_trees=5, max_depth=3)
    rep2 = churn_report(features, {"segment": ["low"]}, NUMERIC, CATEGORICAL, LABEL, ID,
                        previous=rep["model"], previous_filters={"segment": ["mid", "high"]}, num_trees=5, max_depth=3)
    metrics = {r["metric"] for r in rep2["stats_vs_previous"].collect()}
    assert metrics == {"mean", "median", "mode", "std", "min", "max", "count"}
    assert rep2["kpis"].first()["users"] == features.filter("segment = 'low'").count()
    spec = FilterSpec.from_params({"date_from": date(2024, 1, 1), "date_to": date(2024, 1, 7),
                                   "cities": ["A"], "series_dim": "Categoría (vendor)"})
    assert spec.series_dim is Dim.CATEGORY and spec.cities == ("A",) and spec.statuses == ()


def test_auc_buckets_are_bounded_for_clustered_scores(spark):
    n = 20_000
    df = spark.range(n).selectExpr("case when id = 0 then 1e6 else 0.5 + id / 1e9 end as s", "1L as pos", "1L as neg")
    most = cm.score_buckets(df, []).groupBy("b").count().agg(F.max("count")).first()[0]
    assert most <= 2 * n / cm.AUC_BUCKETS


def test_histogram_of_a_tiny_and_a_wide_span(spark):
    for scale in (2e-6, 1.0, 3e7):
        df = spark.range(1000).selectExpr(f"id / 999.0 * {scale!r}D as churn_probability")
        rows = cm.risk_histogram(df).collect()
        assert 8 <= len(rows) <= 29 and sum(r["customers"] for r in rows) == 1000
        assert all(r["median"] == pytest.approx(scale / 2) and r["mean"] == pytest.approx(scale / 2) for r in rows)


def test_split_without_strata_when_a_class_is_too_small(spark):
    df = spark.range(50).selectExpr("id as customer_id", "case when id = 7 then 1 else 0 end as churn")
    got = prep.stratified_split(df, "customer_id", "churn").collect()
    assert len(got) == 50 and sum(r["is_test"] for r in got) == 10
