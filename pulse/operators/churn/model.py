"""Churn model on Spark ML: training, scoring, permutation importance, retraining, versioning.

The fitted ``PipelineModel`` carries its own preprocessing, so scoring new data
repeats exactly what training saw:

1. ``SQLTransformer`` fills NULLs with the training split's exact medians/modes;
2. ``StringIndexer(handleInvalid='keep')`` + ``OneHotEncoder(dropLast=True)``: the
   dropped slot is the unknown bucket, so an unseen category encodes as all zeros;
3. ``VectorAssembler`` -> ``RandomForestClassifier`` with "balanced" class weights. Each row keeps the node it has
   reached in every tree (``cacheNodeIds``), so a pass does not walk the trees again.

A forest of many trees over rows that one task can hold is grown by ``forest``: whole trees side by side, a task each, instead of
a job for each level.

Spark ML holds a forest whole in the driver. A forest of many trees over more rows is therefore grown as several forests
of a few trees each, with seeds of their own, which is the same method: trees are independent, and the forest's
probability is the mean of its trees'. Each is saved below the checkpoint folder and let go; scoring loads a few at a time.

Spark caps tree depth at 30 and bins continuous features (``maxBins``), so trees
are not bit-identical to another library's; quality is checked with properties.
"""

from __future__ import annotations

import dataclasses
import gc
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from threading import Event, Thread

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.operators.common import attach

from pulse.operators.churn import forest
from pulse.operators.churn import metrics as cm
from pulse.operators.churn import prep
from pulse.functions.filters import filter_in
from pulse.session import checkpoint_dir, materialized, new_folder, written


#: Memory for the statistics of one group of tree nodes: each group is a pass over the training rows.
GROUP_MB = 1024
#: Trees from which on they are grown a task each, and bytes of the training rows (a feature's bin: one, label and weight: nine) up to
#: which they are: the driver passes them on, every task holds them.
TASK_TREES, TASK_BYTES = 32, 32 << 20
#: Rows that a task walks through the trees.
WALK_TASK_ROWS = 100_000
#: Training rows of a partition.
TRAIN_ROWS = 250_000
#: Trees times training rows up to which a forest is fitted in one piece, and of each piece of a larger one (a tree at least).
WHOLE_TREE_ROWS, TREE_ROWS = 2_000_000, 640_000
#: Rows of a partition of a piece's fit, and its partitions as long as they stay below TRAIN_ROWS.
PIECE_ROWS, PIECE_PARTS = 2_000, 6
#: Memory for the statistics of a group of tree nodes when several pieces are fitted at once.
PIECE_GROUP_MB = 256
#: Levels of trees between checkpoints of the kept node ids: up to then every task carries the levels' splits along.
CHECKPOINT_LEVELS, PIECE_CHECKPOINT_LEVELS = 10, 2
#: Driver memory of a piece in fitting, for each of its trees and training rows, and the share of the heap for all of them.
#: The rest of the heap is for the jobs of the fits: several fits at once fill it with what their many small jobs leave.
TREE_ROW_BYTES, HEAP_SHARE = 64, 1 / 12
#: Seconds between collections of a driver that holds few pieces: each level of a fit leaves broadcasts of some MB.
COLLECT_S = 4


@dataclasses.dataclass
class ChurnModel:
    """``pipeline`` ends with the forest, or is the preprocessing alone when ``forests`` names the saved pieces, or ``trees`` the
    table of trees over bins between ``cuts``."""
    pipeline: PipelineModel
    num_cols: list[str]
    cat_cols: list[str]
    label_col: str
    id_col: str
    metrics: dict
    forests: list[str] = dataclasses.field(default_factory=list)
    trees: str = ""
    cuts: list[list[float]] = dataclasses.field(default_factory=list)


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(float(v))


def build_pipeline(num_fill: dict, cat_fill: dict, num_cols: list[str], cat_cols: list[str], label_col: str,
                   num_trees: int = 500, max_depth: int = 30, seed: int = 42, use_checkpoints: bool = False,
                   weight_col: str = "weight", group_mb: int = GROUP_MB, checkpoint_levels: int = CHECKPOINT_LEVELS) -> Pipeline:
    fills = [f"coalesce(cast(`{c}` AS double), CAST({_sql_literal(num_fill.get(c))} AS double)) AS `{c}__imp`"
             for c in num_cols]
    fills += [f"coalesce(cast(`{c}` AS string), {_sql_literal(cat_fill.get(c))}) AS `{c}__imp`" for c in cat_cols]
    impute = SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__")
    stages = [impute]
    ohe_cols = []
    if cat_cols:
        idx = StringIndexer(inputCols=[f"{c}__imp" for c in cat_cols], outputCols=[f"{c}__idx" for c in cat_cols],
                            handleInvalid="keep", stringOrderType="alphabetAsc")
        ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cat_cols], outputCols=[f"{c}__oh" for c in cat_cols],
                            dropLast=True, handleInvalid="keep")
        stages += [idx, ohe]
        ohe_cols = [f"{c}__oh" for c in cat_cols]
    stages.append(VectorAssembler(inputCols=[f"{c}__imp" for c in num_cols] + ohe_cols, outputCol="features"))
    rf = RandomForestClassifier(featuresCol="features", labelCol=label_col, weightCol=weight_col,
                                numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                featureSubsetStrategy="sqrt", cacheNodeIds=True, maxMemoryInMB=group_mb,
                                checkpointInterval=checkpoint_levels if use_checkpoints else -1)
    stages.append(rf)
    return Pipeline(stages=stages)


def train_forest(df: DataFrame, num_cols: list[str], cat_cols: list[str], label_col: str, id_col: str,
                 num_trees: int = 500, max_depth: int = 30, seed: int = 42,
                 test_fraction: float = 0.2) -> ChurnModel:
    """Stratified split, fit on the training rows, evaluate AUC and F1 on the test rows.

    Fill values and class weights come from the training rows only.  Only per-feature
    fill values and the four metrics reach the driver.
    """
    # The split feeds several passes (fill values, weights, the fit, evaluation): it is
    # written to the cluster's checkpoint folder, or kept by the session where there is none.
    with materialized(prep.stratified_split(df, id_col, label_col, test_fraction, seed)) as split:
        train = split.filter(~F.col("is_test")).drop("is_test")
        test = split.filter(F.col("is_test")).drop("is_test")
        num_fill = {r["feature"]: r["median"] for r in prep.numeric_medians(train, num_cols).collect()}
        cat_fill = {r["feature"]: r["mode"] for r in prep.categorical_modes(train, cat_cols).collect()} if cat_cols else {}
        train_w = prep.with_class_weights(train, label_col)
        n = {r["is_test"]: r["count"] for r in split.groupBy("is_test").count().collect()}
        n_train = int(n.get(False, 0))
        whole = num_trees * n_train <= WHOLE_TREE_ROWS
        pipe = build_pipeline(num_fill, cat_fill, num_cols, cat_cols, label_col, num_trees, max_depth, seed,
                              use_checkpoints=checkpoint_dir(df.sparkSession) is not None,
                              group_mb=GROUP_MB if whole else PIECE_GROUP_MB,
                              checkpoint_levels=CHECKPOINT_LEVELS if whole else PIECE_CHECKPOINT_LEVELS)
        if whole:
            # hundreds of trees make a few rows much work: no fewer partitions than cores
            cores = df.sparkSession.sparkContext.defaultParallelism
            train_w = train_w.repartition(max(cores, n_train // TRAIN_ROWS))
            grown = {"pipeline": pipe.fit(train_w.withColumn(label_col, F.col(label_col).cast("double")))}
        else:
            # a row's draws depend on its place: rows are dealt and sorted by their values
            train_w = (train_w.repartition(_piece_parts(n_train), id_col)
                       .sortWithinPartitions(id_col, label_col, *num_cols, *cat_cols))
            grown = _fit_parts(pipe, train_w.withColumn(label_col, F.col(label_col).cast("double")), label_col, n_train)
        model = ChurnModel(num_cols=num_cols, cat_cols=cat_cols, label_col=label_col, id_col=id_col, metrics={"n_train": n_train}, **grown)
        scored = score(model, test)
        auc = cm.roc_auc(scored, label_col).first()["roc_auc"]
        f1 = cm.f1_at_half(scored, label_col).first()["f1"]
        model.metrics = {"roc_auc": float(auc), "f1": float(f1), "n_train": n_train,
                         "n_test": int(n.get(True, 0))}
        return model


def _pieces(num_trees: int, n_train: int) -> list[int]:
    """Trees of each piece; they follow from the rows alone, whatever the cluster."""
    per = max(1, TREE_ROWS // n_train)
    return [min(per, num_trees - i) for i in range(0, num_trees, per)]


def _piece_parts(n_train: int) -> int:
    """Partitions of a piece's fit; they follow from the rows alone, whatever the cluster."""
    return max(1, min(PIECE_PARTS, n_train // PIECE_ROWS), n_train // TRAIN_ROWS)


def _at_once(spark, n_train: int, trees: int) -> int:
    """Pieces that the driver may hold together: by its heap, no more than cores, one at least."""
    context = spark.sparkContext
    heap = context._jvm.java.lang.Runtime.getRuntime().maxMemory()
    return max(1, min(context.defaultParallelism, int(heap * HEAP_SHARE / (TREE_ROW_BYTES * n_train * trees))))


def _together(spark, width: int, fn, items: list) -> list:
    """``fn`` of each item, ``width`` Spark jobs at a time (as the tuning classes of Spark ML do)."""
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), items))


def _few(spark, width: int) -> bool:
    """Whether the driver's heap holds fewer pieces than there are cores."""
    return width < spark.sparkContext.defaultParallelism


def _let_go(spark, width: int) -> None:
    """Have a driver that holds few pieces collect what the last ones left: its heap would else grow to its limit,
    and Spark drops broadcasts only when their handles are collected."""
    if _few(spark, width):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


@contextmanager
def _letting_go(spark, width: int):
    """Inside the block such a driver collects every few seconds too: Spark by itself asks for it every 30 minutes only."""
    done = Event()

    def collect() -> None:
        while not done.wait(COLLECT_S):
            _let_go(spark, width)

    thread = Thread(target=collect, daemon=True)
    if _few(spark, width):
        thread.start()
    try:
        yield
    finally:
        done.set()
        if thread.ident:
            thread.join()


def _fit_parts(pipe: Pipeline, train: DataFrame, label_col: str, n_train: int) -> dict:
    """The fitted preprocessing, and the trees: one table of all, or the folders of the forest's pieces."""
    *stages, last = pipe.getStages()
    prepared = Pipeline(stages=stages).fit(train)
    # a checkpoint keeps rows and partitions as dealt, however many cores read it
    with materialized(prepared.transform(train).select("features", label_col, last.getWeightCol())) as rows:
        if last.getNumTrees() >= TASK_TREES:
            width = rows.first()["features"].size
            labels = {r[0] for r in rows.select(label_col).distinct().collect()}
            if n_train * (width + 9) <= TASK_BYTES and labels == {0.0, 1.0}:
                trees, cuts = forest.grown(_unboxed(rows), label_col, width, last.getNumTrees(), last.getMaxDepth(), last.getSeed())
                return {"pipeline": prepared, "trees": trees, "cuts": cuts}
        return {"pipeline": prepared, "forests": _fit_pieces(last, rows, n_train)}


def _unboxed(rows: DataFrame) -> DataFrame:
    """The features as ``_x``: array<double>."""
    return rows.withColumn("_x", vector_to_array("features")).drop("features")


def _fit_pieces(last: RandomForestClassifier, rows: DataFrame, n_train: int) -> list[str]:
    """The folders of the forest's pieces.

    As many pieces are fitted side by side as the driver may hold, each over a few partitions: every partition of a fit
    fills statistics for all nodes, and at depth there are more nodes than rows in them.
    """
    spark = rows.sparkSession
    base, trees = new_folder(spark), _pieces(last.getNumTrees(), n_train)
    width = _at_once(spark, n_train, trees[0])

    def fit(i: int) -> str:
        piece = last.copy({last.numTrees: trees[i], last.seed: last.getSeed() + i})
        piece.fit(rows).write().save(f"{base}/{i}")
        _let_go(spark, width)
        return f"{base}/{i}"

    with _letting_go(spark, width):
        return _together(spark, width, fit, list(range(len(trees))))


def _votes(spark, base: DataFrame, forests: list[str]) -> tuple[DataFrame, int]:
    """What the trees of some pieces give to every row, written, and the number of trees."""
    votes, shares, trees = base.select("_row", "features"), [], 0
    for i, piece in enumerate(_together(spark, len(forests), RandomForestClassificationModel.load, forests)):
        votes = piece.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{i}").transform(votes)
        shares.append(vector_to_array(f"_p{i}")[1] * piece.getNumTrees)
        trees += piece.getNumTrees
    return written(votes.select("_row", reduce(lambda a, b: a + b, shares).alias("_votes"))), trees


def _with_probability(model: ChurnModel, df: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` of every row and its ``churn_probability``.

    A forest in pieces is loaded a few pieces at a time: each wave writes the votes that its trees give to every row,
    and the votes are added up exactly, so their order does not matter. These passes run when this is called.
    """
    prepared = model.pipeline.transform(df)
    if not model.forests and not model.trees:
        return prepared.select(*cols, vector_to_array("probability")[1].alias("churn_probability"))
    spark, n_train = df.sparkSession, model.metrics["n_train"]
    kept = prepared.select(F.monotonically_increasing_id().alias("_row"), *cols, "features")
    waves, trees = [], 0
    if model.trees:
        base, table = written(forest.with_bins(_unboxed(kept), model.cuts)), spark.read.parquet(model.trees)
        parts = max(2 * spark.sparkContext.defaultParallelism, base.count() // WALK_TASK_ROWS)
        for wave in forest.waves(table):
            votes, n = forest.wave_votes(base, table, wave, parts)
            waves.append(votes)
            trees += n
    else:
        base = written(kept)
        width = _at_once(spark, n_train, max(1, TREE_ROWS // n_train))
        with _letting_go(spark, width):
            for at in range(0, len(model.forests), width):
                votes, n = _votes(spark, base, model.forests[at:at + width])
                waves.append(votes)
                trees += n
                _let_go(spark, width)
    total = (reduce(DataFrame.unionByName, waves).groupBy("_row")
             .agg((F.sum(F.col("_votes").cast("decimal(38,18)")).cast("double") / trees).alias("churn_probability")))
    return base.select("_row", *cols).join(total, "_row").drop("_row")


def score(model: ChurnModel, df: DataFrame, keep: tuple[str, ...] = ("city", "segment", "plan_type")) -> DataFrame:
    """id, kept attributes, label (if present) and ``churn_probability`` (P(class 1))."""
    cols = [model.id_col] + [c for c in keep if c in df.columns]
    if model.label_col in df.columns:
        cols.append(model.label_col)
    return _with_probability(model, df, cols)


def train_metrics(spark, model: ChurnModel) -> DataFrame:
    m = model.metrics
    return spark.createDataFrame([(m["n_train"], m["n_test"], m["roc_auc"], m["f1"])],
                                 "n_train long, n_test long, roc_auc double, f1 double")


def _partnered(t: DataFrame, cols: list[str], id_col: str, seed: int, buckets: int) -> DataFrame:
    """Each row joined to its partner under a seeded permutation inside random buckets.

    Buckets bound each window partition; within a bucket the row ranked r by one hash
    is paired with the row ranked r by another.  Adds ``_p_<col>`` (the partner's
    value) for every column in ``cols``: one shuffle serves every feature.
    """
    t = t.withColumn("_b", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed * 7 + 1)), F.lit(buckets)))
    w1 = Window.partitionBy("_b").orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)
    w2 = Window.partitionBy("_b").orderBy(F.xxhash64(F.col(id_col), F.lit(seed + 1)), id_col)
    left = t.withColumn("_r", F.row_number().over(w1))
    right = t.select("_b", F.row_number().over(w2).alias("_r"), *[F.col(c).alias(f"_p_{c}") for c in cols])
    return left.join(right, ["_b", "_r"]).drop("_b", "_r")


def permutation_importance(model: ChurnModel, test: DataFrame, n_repeats: int = 5, seed: int = 42,
                           buckets: int = 64) -> DataFrame:
    """(feature, importance): mean drop of test ROC AUC when one raw feature is permuted.

    Rows are permuted inside a fixed number of hash buckets. Per repeat, one partner join provides the permuted value of every feature; the
    (feature, repeat) variants are stacked with a tag, scored in one ``transform`` and
    their AUCs computed by one grouped aggregate.  Negative values mean the permuted
    column scored better (noise), as in the source's importance export.
    """
    feats = model.num_cols + model.cat_cols
    cols = test.columns
    stacked = None
    for r in range(n_repeats):
        pt = _partnered(test, feats, model.id_col, seed + 101 * r, buckets)
        # every variant of a row is generated next to it (explode): no union of branches
        variants = [F.struct(*[F.col(x) for x in cols], F.lit("__base__").alias("_f"))] if r == 0 else []
        variants += [F.struct(*[(F.col(f"_p_{x}") if x == c else F.col(x)).alias(x) for x in cols],
                              F.lit(c).alias("_f")) for c in feats]
        part = pt.select(F.explode(F.array(*variants)).alias("_v")).select("_v.*").withColumn("_rep", F.lit(r))
        stacked = part if stacked is None else stacked.unionByName(part)
    scored = _with_probability(model, stacked, ["_f", "_rep", model.label_col])
    aucs = cm.roc_auc(scored, model.label_col, group_cols=("_f", "_rep"))
    base_auc = aucs.filter(F.col("_f") == "__base__").select(F.col("roc_auc").alias("_base"))
    return (aucs.filter(F.col("_f") != "__base__").transform(attach(base_auc))
            .groupBy(F.col("_f").alias("feature"))
            .agg(F.avg(F.col("_base") - F.col("roc_auc")).alias("importance")))


def retrain_on_filter(df: DataFrame, filters: dict[str, list[str]], **train_kw) -> tuple[ChurnModel, DataFrame]:
    """Train on the population passing ``filters`` (empty list = no filter) and report the
    metrics with the filters used (kept as the next run's "previous" population)."""
    pop = filter_in(df, filters)
    model = train_forest(pop, **train_kw)
    m = model.metrics
    info = df.sparkSession.createDataFrame(
        [(m["n_train"], m["n_test"], m["roc_auc"], m["f1"],
          ";".join(f"{k}={','.join(v)}" for k, v in sorted(filters.items()) if v))],
        "n_train long, n_test long, roc_auc double, f1 double, filters string")
    return model, info


# ---- model versions --------------------------------------------------------------------------
# Versions live under one base path on the shared filesystem (any Hadoop URI):
# ``current/`` (what scoring loads) and ``original/`` (the first model, restorable).
# Metadata is a one-row JSON written by Spark next to each pipeline. A forest in pieces, or a table of trees, is kept once
# below ``forests/`` and named in the metadata of the versions that use it.

def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _write_meta(spark, model: ChurnModel, path: str) -> None:
    import json
    meta = json.dumps({"num_cols": model.num_cols, "cat_cols": model.cat_cols, "label_col": model.label_col,
                       "id_col": model.id_col, "metrics": model.metrics, "forests": model.forests, "trees": model.trees,
                       "cuts": model.cuts})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(path + "/_pulse_meta")


def save_model(model: ChurnModel, base_path: str) -> str:
    """Save as ``current``; the first save is also kept as ``original``."""
    spark = _active_spark()
    cur, orig = f"{base_path}/current", f"{base_path}/original"
    model = _kept(model, f"{base_path}/forests")
    model.pipeline.write().overwrite().save(cur)
    _write_meta(spark, model, cur)
    if not _exists(spark, orig):
        model.pipeline.write().save(orig)
        _write_meta(spark, model, orig)
    return cur


def _keep_pieces(forests: list[str], base: str) -> list[str]:
    """The names below ``base`` of the pieces, copied one at a time unless they are there already."""
    if not forests or forests[0].startswith(base + "/"):
        return [f.removeprefix(base + "/") for f in forests]
    version = uuid.uuid4().hex
    for i, f in enumerate(forests):
        RandomForestClassificationModel.load(f).write().save(f"{base}/{version}/{i}")
    return [f"{version}/{i}" for i in range(len(forests))]


def _kept(model: ChurnModel, base: str) -> ChurnModel:
    """The model with its pieces or trees named as they are kept below ``base``, copied there unless they are already."""
    trees = model.trees.removeprefix(base + "/")
    if trees and trees == model.trees:
        trees = uuid.uuid4().hex
        _active_spark().read.parquet(model.trees).write.parquet(f"{base}/{trees}")
    return dataclasses.replace(model, forests=_keep_pieces(model.forests, base), trees=trees)


def load_model(base_path: str, version: str = "current") -> ChurnModel:
    import json
    spark = _active_spark()
    d = f"{base_path}/{version}"
    meta = json.loads(spark.read.text(d + "/_pulse_meta").first()["value"])
    return ChurnModel(PipelineModel.load(d), meta["num_cols"], meta["cat_cols"], meta["label_col"],
                      meta["id_col"], meta["metrics"], [f"{base_path}/forests/{f}" for f in meta.get("forests", [])],
                      f"{base_path}/forests/{meta['trees']}" if meta.get("trees") else "", meta.get("cuts", []))


def restore_original(base_path: str) -> ChurnModel:
    """Make the original model current again."""
    m = load_model(base_path, "original")
    m.pipeline.write().overwrite().save(f"{base_path}/current")
    _write_meta(_active_spark(), _kept(m, f"{base_path}/forests"), f"{base_path}/current")
    return m


def _active_spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
