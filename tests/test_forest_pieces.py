"""A forest grown and scored in pieces: the whole forest's trees, bounded in the driver, the mean of all its votes."""

import time
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulse.operators.churn import model as mm

AT_ONCE = mm._at_once
KW = dict(num_cols=["x", "y"], cat_cols=["c"], label_col="churn", id_col="customer_id", num_trees=5, max_depth=4)


@pytest.fixture(scope="module")
def rows(spark):
    """400 rows; ids come twice, some values are null."""
    return spark.range(400).selectExpr("id div 2 AS customer_id", "if(id % 9 = 0, null, id * 37 % 101) AS x", "double(id * 53 % 89) AS y",
                                       "if(id % 7 = 0, null, array('a', 'b', 'c')[id % 3]) AS c", "int(id * 37 % 101 > 40 + id % 23) AS churn")


@pytest.fixture(scope="module", autouse=True)
def pieces():
    """Pieces of two trees, two of them at once."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mm, "WHOLE_TREE_ROWS", 1000)
        patch.setattr(mm, "TREE_ROWS", 700)
        patch.setattr(mm, "_at_once", lambda *a: 2)
        yield


@pytest.fixture(scope="module")
def m(rows, pieces):
    return mm.train_forest(rows, **KW)


def test_no_fit_holds_more_trees_than_its_piece(m):
    assert [RandomForestClassificationModel.load(f).getNumTrees for f in m.forests] == [2, 2, 1]
    assert m.metrics["n_train"] == 320
    assert not any(isinstance(s, RandomForestClassificationModel) for s in m.pipeline.stages)


def test_pieces_follow_from_the_rows(monkeypatch):
    monkeypatch.setattr(mm, "TREE_ROWS", 640_000)
    assert mm._pieces(500, 72_000) == [8] * 62 + [4] and mm._pieces(3, 10**9) == [1, 1, 1]


def test_a_small_driver_fits_and_loads_one_piece_at_a_time():
    """With 750 MB of heap and 90,000 customers: 8 trees in the driver, by a fit that still uses several tasks."""
    heap = MagicMock()
    heap.sparkContext.defaultParallelism = 6
    memory = heap.sparkContext._jvm.java.lang.Runtime.getRuntime.return_value.maxMemory
    for mb, at_once in ((750, 1), (8192, 6)):
        memory.return_value = mb << 20
        for n_train in (12_000, 72_000, 720_000):
            assert AT_ONCE(heap, n_train, max(1, 640_000 // n_train)) == at_once
    assert [mm._piece_parts(n) for n in (100, 5_000, 72_000, 720_000, 2_500_000)] == [1, 2, 6, 6, 10]


def test_a_fit_reads_its_rows_as_they_were_dealt(rows, monkeypatch):
    """Partitions follow from the rows, also where files are read by other cores than they were written by."""
    dealt, fit = [], mm.RandomForestClassifier._fit
    monkeypatch.setattr(mm, "PIECE_ROWS", 80)
    monkeypatch.setattr(mm.RandomForestClassifier, "_fit", lambda self, df: dealt.append(df.rdd.getNumPartitions()) or fit(self, df))
    model = mm.train_forest(rows, **KW)
    assert dealt == [4, 4, 4] and model.metrics["n_train"] == 320 and 0.8 < model.metrics["roc_auc"] <= 1


def test_score_is_the_mean_of_all_trees(rows, m):
    got = mm.score(m, rows.withColumn("segment", F.col("x")), keep=("segment",)).toPandas()
    assert list(got.columns) == ["customer_id", "segment", "churn", "churn_probability"] and len(got) == 400
    ready, votes = m.pipeline.transform(rows), 0
    for f in m.forests:
        piece = RandomForestClassificationModel.load(f)
        p = piece.transform(ready).select("customer_id", "y", vector_to_array("probability")[1].alias("p")).toPandas()
        votes = votes + p.sort_values(["customer_id", "y"])["p"].to_numpy() * piece.getNumTrees
    assert np.sort(votes / 5) == pytest.approx(np.sort(got["churn_probability"].to_numpy()), abs=1e-12)
    assert got["churn_probability"].nunique() > 10 and got["churn_probability"].between(0, 1).all()


def test_same_rows_same_forest(rows, m):
    assert mm.train_forest(rows, **KW).metrics == m.metrics and 0.8 < m.metrics["roc_auc"] <= 1


def test_importance_in_pieces(rows, m):
    got = {r["feature"]: r["importance"] for r in mm.permutation_importance(m, rows, n_repeats=2).collect()}
    assert sorted(got) == ["c", "x", "y"] and max(got, key=got.get) == "x" and got["x"] > 0.1


def test_versions_of_a_forest_in_pieces(rows, m, scratch):
    mm.save_model(m, scratch)
    mm.save_model(mm.train_forest(rows, **KW | {"num_trees": 4}), scratch)
    mm.save_model(mm.load_model(scratch), scratch)
    assert len(mm.load_model(scratch).forests) == 2
    mm.restore_original(scratch)
    back = mm.load_model(scratch)
    assert len(back.forests) == 3 and back.metrics == m.metrics
    a, b = (mm.score(x, rows).orderBy("customer_id", "churn_probability").toPandas() for x in (m, back))
    assert a.equals(b)


def _collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())


def test_a_small_driver_collects_after_each_piece(spark, rows, monkeypatch):
    """What a piece leaves behind goes before the next one is grown or loaded; a driver that holds many pieces is let alone."""
    monkeypatch.setattr(mm, "_at_once", lambda *a: 1)
    before = _collections(spark)
    small = mm.train_forest(rows, **KW)
    assert len(small.forests) == 3 and _collections(spark) - before >= 6  # three fits, three waves of votes
    asked = MagicMock()
    asked.sparkContext.defaultParallelism = 4
    mm._let_go(asked, 4)
    assert not asked.sparkContext._jvm.System.gc.called
    mm._let_go(asked, 3)
    assert asked.sparkContext._jvm.System.gc.called


def test_tasks_of_a_piece_carry_few_levels(rows, monkeypatch, m):
    """Kept node ids are checkpointed every second level: between, each task holds the splits of all levels since."""
    levels, fit = [], mm.RandomForestClassifier._fit
    monkeypatch.setattr(mm.RandomForestClassifier, "_fit", lambda self, df: levels.append(self.getCheckpointInterval()) or fit(self, df))
    monkeypatch.setattr(mm, "checkpoint_dir", lambda spark: "set")
    assert mm.train_forest(rows, **KW).metrics == m.metrics and levels == [2, 2, 2]


def test_a_small_driver_collects_within_a_fit(spark, rows, monkeypatch):
    """What the levels of a fit leave goes meanwhile, not after the piece; a driver that holds many pieces is let alone."""
    seen, fit = [], mm.RandomForestClassifier._fit

    def fitted(self, df):
        before, until = _collections(spark), time.time() + 10
        model = fit(self, df)
        while _collections(spark) == before and time.time() < until:
            time.sleep(0.05)
        seen.append(_collections(spark) - before)
        return model

    monkeypatch.setattr(mm, "COLLECT_S", 0.2, raising=False)
    monkeypatch.setattr(mm, "_at_once", lambda *a: 1)
    monkeypatch.setattr(mm.RandomForestClassifier, "_fit", fitted)
    assert len(mm.train_forest(rows, **KW).forests) == 3 and len(seen) == 3 and min(seen) > 0
    many = MagicMock()
    many.sparkContext.defaultParallelism = 4
    with mm._letting_go(many, 4):
        time.sleep(0.5)
    assert not many.sparkContext._jvm.System.gc.called
