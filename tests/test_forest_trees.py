"""A forest of many trees over rows that a task can hold: trees grown a task each, by the method of Spark ML's forest."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.operators.churn import forest
from pulse.operators.churn import metrics as cm
from pulse.operators.churn import model as mm

KW = dict(num_cols=["x", "y"], cat_cols=["c"], label_col="churn", id_col="customer_id", num_trees=40, max_depth=5)


@pytest.fixture(scope="module")
def rows(spark):
    """400 rows; ids come twice, some values are null, columns are named as the operator's own might be."""
    return spark.range(400).selectExpr("id div 2 AS customer_id", "if(id % 9 = 0, null, id * 37 % 101) AS x", "double(id * 53 % 89) AS y",
                                       "if(id % 7 = 0, null, array('a', 'b', 'c')[id % 3]) AS c", "int(id * 37 % 101 > 40 + id % 23) AS churn")


@pytest.fixture(scope="module", autouse=True)
def large():
    """What is a large forest here."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mm, "WHOLE_TREE_ROWS", 1000)
        yield


@pytest.fixture(scope="module")
def m(rows, large):
    return mm.train_forest(rows, **KW)


def trees_of(spark, m):
    return [bytes(r["data"]) for r in sorted(spark.read.parquet(m.trees).collect(), key=lambda r: r["tree"])]


def walk(data, bins):
    """The share that one row's leaf gives, node by node."""
    feature, last, share = forest.unpack(data)
    node, inner = 0, feature >= 0
    while inner[node]:
        node = 2 * int(inner[:node].sum()) + 1 + int(bins[feature[node]] > last[node])
    return share[int((~inner[:node]).sum())]


def test_no_job_a_level(rows, monkeypatch):
    """All trees are grown, and Spark ML's fit, whose levels are jobs one after the other, is not used for it."""
    def fit(*a):
        raise AssertionError("fitted level by level")
    monkeypatch.setattr(mm.RandomForestClassifier, "_fit", fit)
    model = mm.train_forest(rows, **KW)
    assert not model.forests and rows.sparkSession.read.parquet(model.trees).select("tree").distinct().count() == 40
    assert (model.metrics["n_train"], model.metrics["n_test"]) == (320, 80) and 0.8 < model.metrics["roc_auc"] <= 1


def test_score_is_the_mean_of_all_trees(spark, rows, m, monkeypatch):
    monkeypatch.setattr(forest, "WAVE_BYTES", sum(map(len, trees_of(spark, m))) // 3)
    assert len(forest.waves(spark.read.parquet(m.trees))) > 2
    # columns _x-like, and one of the features, kept by name
    got = mm.score(m, rows.withColumn("bins", F.col("y")), keep=("x", "y", "bins")).toPandas()
    assert list(got.columns) == ["customer_id", "x", "y", "bins", "churn", "churn_probability"] and len(got) == 400
    ready = forest.with_bins(mm._unboxed(m.pipeline.transform(rows)).select("customer_id", "y", "_x"), m.cuts).toPandas()
    trees = trees_of(spark, m)
    want = [np.mean([walk(t, b) for t in trees]) for b in ready.sort_values(["customer_id", "y"])["_bins"].map(bytes)]
    assert got.sort_values(["customer_id", "y"])["churn_probability"].to_numpy() == pytest.approx(np.array(want), abs=1e-12)
    assert got["churn_probability"].nunique() > 10 and got["churn_probability"].between(0, 1).all()


def test_same_rows_same_trees(spark, rows, m):
    again = mm.train_forest(rows.repartition(7), **KW)
    assert trees_of(spark, again) == trees_of(spark, m) and again.metrics == m.metrics and len(set(trees_of(spark, m))) == 40


def test_scores_as_spark_mls_forest(spark, rows, m, monkeypatch):
    monkeypatch.setattr(mm, "WHOLE_TREE_ROWS", 10**9)
    spark_ml = mm.train_forest(rows, **KW)
    assert not spark_ml.trees
    a, b = (mm.score(x, rows, keep=("y",)).toPandas().sort_values(["customer_id", "y"])["churn_probability"].to_numpy() for x in (m, spark_ml))
    assert np.corrcoef(a, b)[0, 1] > 0.98 and abs(a - b).mean() < 0.05
    assert m.metrics["roc_auc"] == pytest.approx(spark_ml.metrics["roc_auc"], abs=0.05)


def test_other_forests_are_grown_in_pieces(rows, monkeypatch):
    """Few trees, rows that a task does not hold, and labels other than 0 and 1 go on by Spark ML's forest."""
    few = KW | {"num_trees": 5, "max_depth": 2}
    assert len(mm.train_forest(rows, **few).forests) == 1
    monkeypatch.setattr(mm, "TASK_TREES", 5)
    monkeypatch.setattr(mm, "TASK_BYTES", 320 * 15 - 1)
    assert len(mm.train_forest(rows, **few).forests) == 1
    monkeypatch.setattr(mm, "TASK_BYTES", 320 * 15)  # x, y, three categories and the unknown, label and weight
    assert mm.train_forest(rows, **few).trees
    assert len(mm.train_forest(rows.withColumn("churn", F.lit(1)), **few).forests) == 1


def test_importance(rows, m):
    got = {r["feature"]: r["importance"] for r in mm.permutation_importance(m, rows, n_repeats=2).collect()}
    assert sorted(got) == ["c", "x", "y"] and max(got, key=got.get) == "x" and got["x"] > 0.1


def test_versions(spark, rows, m, scratch):
    mm.save_model(m, scratch)
    mm.save_model(mm.train_forest(rows, **KW | {"num_trees": 33}), scratch)
    mm.save_model(mm.load_model(scratch), scratch)
    assert len(trees_of(spark, mm.load_model(scratch))) == 33
    mm.restore_original(scratch)
    back = mm.load_model(scratch)
    assert trees_of(spark, back) == trees_of(spark, m) and back.trees.startswith(scratch) and back.cuts == m.cuts
    assert dataclasses.replace(back, pipeline=None, trees="") == dataclasses.replace(m, pipeline=None, trees="")
    a, b = (cm.roc_auc(mm.score(x, rows), "churn").first()["roc_auc"] for x in (m, back))
    assert a == b


def table(n=600, wide=6, seed=1):
    r = np.random.default_rng(seed)
    bins = r.integers(0, 32, (n, wide)).astype(np.uint8)
    label = (r.random(n) < 0.2 + 0.6 * (bins[:, 2] > 12) * (bins[:, 4] > 5)).astype(np.uint8)
    return bins, label, np.where(label == 1, 0.7, 1.9)


def gini_gain(left, label, w):
    def impurity(of):
        p = w[of & (label == 1)].sum() / w[of].sum()
        return 2 * p * (1 - p) * w[of].sum()
    return 0 if not left.any() or left.all() else impurity(np.ones(len(left), bool)) - impurity(left) - impurity(~left)


def test_every_split_is_the_best_and_leaves_hold_the_shares():
    """One tree against its own bootstrap, node by node, all features tried."""
    bins, label, weight = table()
    data = forest.grow(bins, label, weight, 5, 3, 4, subset=6)
    feature, last, share = forest.unpack(data)
    w = weight * np.random.default_rng([5, 3]).poisson(1.0, len(label))
    assert ((feature >= 0).sum() + 1 == (feature < 0).sum()) and (feature >= 0).sum() > 3
    rows, inner, leaf = {0: w > 0}, 0, 0
    for node in range(len(feature)):
        of = rows[node]
        assert of.any()
        if feature[node] < 0:
            assert share[leaf] == pytest.approx(w[of & (label == 1)].sum() / w[of].sum())
            leaf += 1
            continue
        left = bins[:, feature[node]] <= last[node]
        tried = [gini_gain(bins[of, f] <= b, label[of], w[of]) for f in range(6) for b in range(31)]
        assert gini_gain(left[of], label[of], w[of]) == pytest.approx(max(tried))
        rows[2 * inner + 1], rows[2 * inner + 2] = of & left, of & ~left
        inner += 1


def test_nodes_are_the_same_in_small_groups(monkeypatch):
    bins, label, weight = table()
    whole = [forest.grow(bins, label, weight, 1, t, 30) for t in range(3)]
    monkeypatch.setattr(forest, "CELLS", 1)
    assert [forest.grow(bins, label, weight, 1, t, 30) for t in range(3)] == whole
    monkeypatch.setattr(forest, "WALK_ROWS", 7)
    assert forest.votes(bins, whole) == pytest.approx([sum(walk(t, b) for t in whole) for b in bins])


def test_unlimited_trees_end_in_pure_leaves_of_other_classes():
    bins, label, weight = table()
    feature, _, share = forest.unpack(forest.grow(bins, label, weight, 1, 0, 30))
    assert set(share) == {0.0, 1.0} and len(feature) > 100
    inner = feature >= 0
    at = np.cumsum(~inner) - 1
    for i in range(int(inner.sum())):  # siblings that are both leaves name different classes
        a, b = 2 * i + 1, 2 * i + 2
        assert inner[a] or inner[b] or share[at[a]] != share[at[b]]


def test_cuts():
    assert forest.cut_points(np.array([1.0, 2, 5]), np.ones(3)) == [1.5, 3.5]
    assert forest.cut_points(np.array([3.0]), np.ones(1)) == []
    assert forest.cut_points(np.array([-np.inf, 0, np.inf]), np.ones(3)) == [-np.inf, 0]
    values = np.sort(np.random.default_rng(2).normal(size=50_000))
    cuts = forest.cut_points(values, np.ones(len(values)))
    assert len(cuts) == 31 and np.diff([0, *np.searchsorted(values, cuts), len(values)]) == pytest.approx(50_000 / 32, rel=0.01)
    heavy = forest.cut_points(np.arange(100.0), np.where(np.arange(100) == 50, 10_000.0, 1))
    assert all(c in heavy for c in (49.5, 50.5)) or len(heavy) < 31
    bins = forest.binned(np.array([[1.0], [1.5], [1.6], [9.0]]), [[1.5, 3.5]])
    assert bins[:, 0].tolist() == [0, 0, 1, 2]
