"""Preprocessing for the churn model: exact imputation, one-hot long form, split, class weights.

* numeric columns: exact median fill (``pulse.functions.stats.medians``; Spark ML's
  ``Imputer`` uses approximate quantiles);
* string columns: most frequent value, ties to the smallest value (``Imputer`` does
  not take strings);
* split: exact per-class test counts (round(0.2 * n_class)), members chosen by a
  seeded hash order, found with exact order statistics (no window over a class);
* class weights: n / (k * n_class), the "balanced" rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.stats import medians, order_statistics
from pulse.operators.common import attach
from pulse.session import materialized


def numeric_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, median) for each numeric column."""
    return medians(df, cols)


def categorical_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mode): most frequent non-null value, ties to the smallest value.

    Counts per (feature, value) are a partial aggregate; the pick per feature is
    ``min(struct(-count, value))``, another aggregate (no sort of a group).
    """
    long = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                   F.col(c).cast("string").alias("value")) for c in cols]))
                      .alias("kv")).select("kv.feature", "kv.value")
            .filter(F.col("value").isNotNull()))
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), "value")).alias("b"))
    return best.select("feature", F.col("b.value").alias("mode"))


def _fill_values(fill: DataFrame, key: str, val: str, cols: list[str]) -> DataFrame:
    """One-row wide frame {col: fill value} from a (feature, value) frame (size: #features)."""
    return fill.groupBy().pivot(key, cols).agg(F.first(val))


def impute(df: DataFrame, num_cols: list[str], cat_cols: list[str],
           num_fill: DataFrame | None = None, cat_fill: DataFrame | None = None) -> DataFrame:
    """Fill NULLs: numeric columns with medians (cast to double), string columns with modes.

    Fill values are fitted on ``df`` unless given (e.g. fitted on the training split).
    """
    out = df
    if num_cols:
        num_fill = num_fill if num_fill is not None else numeric_medians(df, num_cols)
        nf = _fill_values(num_fill, "feature", "median", num_cols)
        out = out.transform(attach(nf.select(*[F.col(c).alias(f"_m_{c}") for c in num_cols])))
    if cat_cols:
        cat_fill = cat_fill if cat_fill is not None else categorical_modes(df, cat_cols)
        cf = _fill_values(cat_fill, "feature", "mode", cat_cols)
        out = out.transform(attach(cf.select(*[F.col(c).alias(f"_c_{c}") for c in cat_cols])))
    keep = [c for c in df.columns if c not in num_cols and c not in cat_cols]
    return out.select(*keep,
                      *[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) for c in num_cols],
                      *[F.coalesce(F.col(c).cast("string"), F.col(f"_c_{c}")).alias(c) for c in cat_cols])


def vocabulary(df: DataFrame, cat_cols: list[str]) -> DataFrame:
    """(feature, value) of every category seen in ``df`` (the one-hot columns)."""
    return (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                          for c in cat_cols])).alias("kv"))
            .select("kv.feature", "kv.value").filter(F.col("value").isNotNull()).distinct())


def one_hot_long(df: DataFrame, id_col: str, cat_cols: list[str], vocab: DataFrame) -> DataFrame:
    """Sparse long form of the one-hot encoding: (id, feature 'col=value', value 1.0).

    A category outside the fitted vocabulary encodes as all zeros (no row), the
    ``handle_unknown='ignore'`` behaviour.
    """
    long = (df.select(id_col, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                           F.col(c).cast("string").alias("value"))
                                                  for c in cat_cols])).alias("kv"))
            .select(id_col, "kv.feature", "kv.value"))
    return (long.join(vocab, ["feature", "value"], "left_semi")
            .select(id_col, F.concat_ws("=", "feature", "value").alias("feature"), F.lit(1.0).alias("value")))


def split_key(id_col: str, seed: int = 42) -> F.Column:
    """Seeded uniform order: first 60 bits of md5(id || '|seed') as a number."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``: per class, the round(test_fraction * n_class) rows first in seeded hash order.

    The per-class threshold is the exact k-th row in (hash, id) order (order
    statistics by interval narrowing), so each class is cut with counts only and one
    comparison per row; ties on the hash are ordered by id.  With fewer than two classes, or a
    class of one row, the split is not stratified: round(test_fraction * n) of all rows.
    The counting passes run when this is called.
    """
    keyed = df.withColumn("_key", split_key(id_col, seed))
    with materialized(keyed) as km:  # released after the counting passes
        n_by = {r[label_col]: r["n"] for r in km.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
        if n_by and (min(n_by.values()) < 2 or len(n_by) < 2):  # a class cannot be in both parts: split all rows alike
            km, label_col_in = km.withColumn("_all", F.lit(0)), "_all"
            n_by = {0: sum(n_by.values())}
        else:
            label_col_in = label_col
        need = {lab: int(_round_half_up(test_fraction * n)) for lab, n in n_by.items()}
        ranks = {lab: [k] for lab, k in need.items() if k > 0}
        if not ranks:
            return df.withColumn("is_test", F.lit(False))
        # k-th row of the order (hash, id) per class: everything up to it is the test set
        th = (order_statistics(km, label_col_in, "_key", ranks, n_by, tiebreak_col=id_col)
              .select(label_col_in, F.struct(F.col("_key").alias("k"), F.col(id_col).alias("i")).alias("_t")))
    if label_col_in == "_all":
        keyed = keyed.withColumn("_all", F.lit(0))
    tagged = keyed.join(F.broadcast(th), label_col_in, "left")  # one row per class
    is_test = F.struct(F.col("_key").alias("k"), F.col(id_col).alias("i")) <= F.col("_t")
    return tagged.select(*df.columns, F.coalesce(is_test, F.lit(False)).alias("is_test"))


def _round_half_up(x: float) -> float:
    import math
    return math.floor(x + 0.5)


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """(label, n, weight) with weight = n_total / (n_classes * n_class)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_k"))
    return (counts.transform(attach(tot))
            .select(label_col, F.col("n").cast("bigint").alias("n"),
                    (F.col("_total").cast("double") / (F.col("_k") * F.col("n"))).alias("weight")))


def with_class_weights(df: DataFrame, label_col: str, weight_col: str = "weight") -> DataFrame:
    w = class_weights(df, label_col).select(label_col, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label_col)  # one row per class
