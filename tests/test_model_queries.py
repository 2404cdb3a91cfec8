"""The model queries' whole results, recomputed with numpy from the returned rows; and the ranking of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.functions.ranking import numbered
from pulse.operators.churn import metrics as cm
from pulse.operators.churn import prep
from pulse.operators.churn.features import CATEGORICAL, ID, LABEL, NUMERIC
from pulse.plans import q_churn
from pulse.plans.catalog import load_all

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def reg():
    trees, depth = q_churn.ML_TREES, q_churn.ML_DEPTH
    q_churn.ML_TREES, q_churn.ML_DEPTH = 12, 6
    yield load_all()
    q_churn.ML_TREES, q_churn.ML_DEPTH = trees, depth


@pytest.fixture(scope="module")
def scores(spark, reg):
    return reg["score_customers"].run(spark, SF).toPandas()


def auc(label, p):
    """Share of (churned, stayed) pairs in the right order, ties by half."""
    up, down = p[label == 1], p[label == 0]
    return float(((up[:, None] > down[None, :]) + 0.5 * (up[:, None] == down[None, :])).mean())


def test_scores_name_every_customer_with_label(spark, reg, scores):
    features = q_churn._features(spark, SF).select(ID, "city", "segment", "plan_type", LABEL).toPandas()
    assert list(scores.columns) == [ID, "city", "segment", "plan_type", LABEL, "churn_probability"]
    a, b = (x.sort_values(ID).reset_index(drop=True) for x in (scores.drop(columns="churn_probability"), features))
    assert a.astype(object).where(a.notna(), None).equals(b.astype(object).where(b.notna(), None))
    assert scores["churn_probability"].between(0, 1).all() and scores["churn_probability"].nunique() > 50


def test_metrics_are_those_of_the_held_out_scores(spark, reg, scores):
    split = prep.stratified_split(q_churn._features(spark, SF), ID, LABEL).select(ID, "is_test").toPandas()
    test = scores.merge(split, on=ID).query("is_test")
    m = reg["train_metrics"].run(spark, SF).first()
    label, p = test[LABEL].to_numpy(), test["churn_probability"].to_numpy()
    said = p >= 0.5
    assert m["roc_auc"] == pytest.approx(auc(label, p), abs=1e-12)
    assert m["f1"] == pytest.approx(2 * (said & (label == 1)).sum() / (said.sum() + (label == 1).sum()), abs=1e-12)
    assert (m["n_train"], m["n_test"]) == (len(scores) - len(test), len(test))


def test_ranking_has_every_customer_in_order(spark, reg, scores):
    got = reg["model_risk_ranking"].run(spark, SF).toPandas().sort_values("rank")
    want = scores.sort_values(["churn_probability", ID], ascending=[False, True])
    assert got[ID].tolist() == want[ID].tolist() and got["rank"].tolist() == list(range(1, len(want) + 1))
    assert got["churn_probability"].tolist() == want["churn_probability"].tolist()
    assert got["percentile"].iloc[-1] == 0 and got["percentile"].iloc[0] == 100 * (len(want) - 1) / len(want)


def test_importance_is_the_drop_of_auc(spark, reg, scores):
    got = {r["feature"]: r["importance"] for r in reg["feature_importance"].run(spark, SF).collect()}
    assert sorted(got) == sorted([*NUMERIC, *CATEGORICAL])
    top = max(got, key=got.get)
    split = prep.stratified_split(q_churn._features(spark, SF), ID, LABEL)
    test = split.where("is_test").drop("is_test")
    rows = [r.asDict() for r in test.collect()]
    base = reg["train_metrics"].run(spark, SF).first()["roc_auc"]
    rng, drops = np.random.default_rng(0), []
    for _ in range(3):  # an independent permutation of the strongest feature: about the same drop
        order = rng.permutation(len(rows))
        frame = spark.createDataFrame([{**r, top: rows[i][top]} for r, i in zip(rows, order, strict=True)], test.schema)
        scored = q_churn.cmodel.score(q_churn._model(spark, SF), frame).toPandas()
        drops.append(base - auc(scored[LABEL].to_numpy(), scored["churn_probability"].to_numpy()))
    assert got[top] > 0 and np.mean(drops) == pytest.approx(got[top], abs=0.05)


def test_retraining_reports_its_population(spark, reg):
    r = reg["retrain_on_filter"].run(spark, SF).first()
    n = q_churn._features(spark, SF).where(F.col("segment").isin("mid", "high")).count()
    assert r["n_train"] + r["n_test"] == n and r["filters"] == "segment=mid,high" and 0 <= r["roc_auc"] <= 1


def test_numbers_are_global_and_by_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 11 > 1, 1).otherwise(F.col("id") % 7).alias("g"),
                                  (F.col("id") * 7919 % 101).alias("v"))
    rows = df.collect()
    order = sorted(rows, key=lambda r: (-r["v"], r["id"]))
    got = {r["id"]: r["position"] for r in numbered(df, [F.desc("v"), F.asc("id")]).collect()}
    assert got == {r["id"]: i for i, r in enumerate(order)}
    got = {r["id"]: r["position"] for r in numbered(df, [F.desc("v"), F.asc("id")], ["g"]).collect()}
    seen = {}
    for r in order:
        assert got[r["id"]] == seen.setdefault(r["g"], 0)
        seen[r["g"]] += 1


def test_no_task_sorts_more_than_its_range(spark):
    """Ranges of one hot group: the sorted table's partitions are about equal, and no plan has a single-task window."""
    from pulse import session
    from pulse.functions import ranking
    plans, sizes = [], []

    def spy(df, parts=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        sizes.extend(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
        return session.written(df, parts)

    ranking.written, kept = spy, ranking.written
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select("id", F.lit(1).alias("g"), F.rand(3).alias("churn_probability"))
        out = cm.risk_ranking_all(df, id_col="id")
        grouped = numbered(df, [F.desc("churn_probability"), F.asc("id")], ["g"])
        plans += [x._jdf.queryExecution().executedPlan().toString() for x in (out, grouped)]
    finally:
        ranking.written = kept
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert "rangepartitioning" in plans[0] and max(sizes) < 2.5 * 40_000 / 8
    windows = [line for p in plans for line in p.splitlines() if "Window" in line and "churn_probability" in line]
    assert not windows
