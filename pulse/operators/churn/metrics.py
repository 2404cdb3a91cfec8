"""Model-quality and risk-distribution metrics over a scored table (label, probability).

All metrics are aggregates: exact integer counts first, one final division, so the
same numbers come out whatever the partitioning.

ROC AUC uses the rank form with average ranks for ties, written without a global
sort: scores are grouped per distinct value (positives, negatives), the values are
bucketed at approximate quantiles of the distinct values, and the count of negatives below
each value is the sum over lower buckets (a window over the bounded bucket table) plus
the sum inside its own bucket (a window over that bucket's distinct values only).
However scores cluster, a bucket holds about 1 / AUC_BUCKETS of the distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.ranking import numbered
from pulse.functions.stats import medians
from pulse.operators.common import attach

AUC_BUCKETS = 512


def _confusion(scored: DataFrame, label: str, prob: str, threshold: float = 0.5) -> DataFrame:
    y = F.col(label) == 1
    p = F.col(prob) >= threshold
    return scored.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                      F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def score_buckets(per_value: DataFrame, g: list[str]) -> DataFrame:
    """``per_value`` (distinct scores ``s``) with ``b``, its bucket between quantiles of the distinct scores."""
    grid = [i / AUC_BUCKETS for i in range(1, AUC_BUCKETS)]
    edges = per_value.groupBy(*g).agg(F.percentile_approx("s", grid, 20 * AUC_BUCKETS).alias("edges"))
    joined = per_value.transform(attach(edges)) if not g else per_value.join(F.broadcast(edges), g)
    return joined.withColumn("b", F.size(F.filter("edges", lambda e: e <= F.col("s")))).drop("edges")


def roc_auc(scored: DataFrame, label: str = "churn", prob: str = "churn_probability",
            group_cols: tuple[str, ...] = ()) -> DataFrame:
    """``roc_auc`` (one row, or one per group); NaN when only one class is present."""
    g = list(group_cols)
    s = scored.select(*g, F.col(label).cast("int").alias("y"), F.col(prob).cast("double").alias("s")) \
              .filter(F.col("s").isNotNull())
    per_value = s.groupBy(*g, "s").agg(F.count_if(F.col("y") == 1).alias("pos"),
                                       F.count_if(F.col("y") != 1).alias("neg"))
    bucketed = score_buckets(per_value, g)
    # negatives in lower buckets: window over at most AUC_BUCKETS rows per group
    per_bucket = bucketed.groupBy(*g, "b").agg(F.sum("neg").alias("bneg"))
    wb = Window.partitionBy(*g).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    lower = per_bucket.select(*g, "b", F.coalesce(F.sum("bneg").over(wb), F.lit(0)).alias("neg_lower"))
    # negatives below inside the same bucket: window over the bucket's distinct scores
    wi = Window.partitionBy(*g, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    inner = bucketed.withColumn("neg_inner", F.coalesce(F.sum("neg").over(wi), F.lit(0)))
    # 2 * (sum of average ranks of positives) - n1 (n1 + 1) = sum pos * (2 * neg_below + neg)
    num2 = (inner.join(lower, [*g, "b"])
            .groupBy(*g)
            .agg(F.sum(F.col("pos") * (2 * (F.col("neg_lower") + F.col("neg_inner")) + F.col("neg"))).alias("num2"),
                 F.sum("pos").alias("n1"), F.sum("neg").alias("n0")))
    return num2.select(*g, F.when((F.col("n1") > 0) & (F.col("n0") > 0),
                                  F.col("num2").cast("double") / (F.lit(2.0) * F.col("n1") * F.col("n0")))
                       .otherwise(F.lit(float("nan"))).alias("roc_auc"))


def f1_at_half(scored: DataFrame, label: str = "churn", prob: str = "churn_probability") -> DataFrame:
    """One row ``f1`` of the positive class at probability >= 0.5; NaN when one class only."""
    c = _confusion(scored, label, prob)
    both = ((F.col("tp") + F.col("fn")) > 0) & ((F.col("fp") + F.col("tn")) > 0)
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return c.select(F.when(~both, F.lit(float("nan")))
                    .when(den > 0, (2 * F.col("tp")).cast("double") / den).otherwise(F.lit(0.0)).alias("f1"))


def classification_report(scored: DataFrame, label: str = "churn", prob: str = "churn_probability") -> DataFrame:
    """Rows '0', '1', 'accuracy', 'macro avg', 'weighted avg' with precision, recall, f1_score, support."""
    c = _confusion(scored, label, prob)

    def div(n, d):
        return F.when(d > 0, n.cast("double") / d).otherwise(F.lit(0.0))

    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    p1, r1 = div(tp, tp + fp), div(tp, tp + fn)
    p0, r0 = div(tn, tn + fn), div(tn, tn + fp)
    f1_1 = div(2 * tp, 2 * tp + fp + fn)
    f1_0 = div(2 * tn, 2 * tn + fn + fp)
    n1, n0 = tp + fn, tn + fp
    n = n1 + n0
    rows = c.select(
        p1.alias("p1"), r1.alias("r1"), f1_1.alias("f1"), p0.alias("p0"), r0.alias("r0"), f1_0.alias("f0"),
        n1.alias("n1"), n0.alias("n0"), n.alias("n"), div(tp + tn, n).alias("acc"))
    def w(a, b):
        return (F.col(a) * F.col("n1") + F.col(b) * F.col("n0")) / F.col("n")

    def row(name, prec, rec, f1, sup):
        return F.struct(F.lit(name).alias("class"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                        sup.cast("bigint").alias("support"))
    none = F.lit(None).cast("double")
    return rows.select(F.explode(F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("n0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("n1")),
        row("accuracy", none, none, F.col("acc"), F.col("n")),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
            (F.col("f0") + F.col("f1")) / 2, F.col("n")),
        row("weighted avg", w("p1", "p0"), w("r1", "r0"), w("f1", "f0"), F.col("n")),
    )).alias("r")).select("r.class", "r.precision", "r.recall", "r.f1_score", "r.support")


def exact_mean_std(x: DataFrame, col: str = "x") -> DataFrame:
    """One row (mean, std, count): order-independent mean and sample std of a double column.

    Sums run in decimal(38,18) (exact, associative), each cast to double once, so the
    result does not depend on partitioning; std uses the two-pass deviation sum.
    """
    dec = "decimal(38,18)"
    first = x.agg(F.sum(F.col(col).cast(dec)).alias("_s"), F.count(F.lit(1)).alias("count"))
    first = first.select((F.col("_s").cast("double") / F.col("count")).alias("mean"), "count")
    dev = F.col(col) - F.col("mean")
    second = (x.transform(attach(first))
              .agg(F.sum((dev * dev).cast(dec)).alias("_ss"), F.first("mean").alias("mean"),
                   F.first("count").alias("count")))
    return second.select("mean", F.when(F.col("count") > 1,
                                        F.sqrt(F.col("_ss").cast("double") / (F.col("count") - 1)))
                         .otherwise(F.lit(0.0)).alias("std"), F.col("count").cast("bigint").alias("count"))


def risk_distribution_stats(scored: DataFrame, prob: str = "churn_probability", snapshot: str | None = None) -> DataFrame:
    """One row: mean, median, mode (of values rounded to 3 decimals, smallest on ties),
    sample std (0.0 when n = 1), min, max, count.  Empty input -> no row."""
    x = scored.select(F.col(prob).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    basic = exact_mean_std(x).transform(attach(x.agg(F.min("x").alias("min"), F.max("x").alias("max"))))
    med = medians(x, ["x"]).select("median")
    mode = (x.groupBy(F.bround("x", 3).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.min(F.struct((-F.col("n")).alias("neg_n"), "v")).alias("b")).select(F.col("b.v").alias("mode")))
    out = basic.filter(F.col("count") > 0).transform(attach(med)).transform(attach(mode))
    cols = ["mean", "median", "mode", "std", "min", "max", "count"]
    if snapshot is not None:
        return out.select(F.lit(snapshot).alias("snapshot"), *cols)
    return out.select(*cols)


def risk_stats_vs_previous(current: DataFrame, previous: DataFrame, prob: str = "churn_probability") -> DataFrame:
    """(metric, current, previous) side by side; a metric missing on one side is NULL there."""
    metrics = ["mean", "median", "mode", "std", "min", "max", "count"]

    def long(df, name):
        st = risk_distribution_stats(df, prob)
        st = st.select(*[F.col(m).cast("double").alias(m) for m in metrics])
        return st.unpivot([], metrics, "metric", name)
    return long(current, "current").join(long(previous, "previous"), "metric", "full")


def risk_histogram(scored: DataFrame, prob: str = "churn_probability", maxbins: int = 28) -> DataFrame:
    """(bin_start, bin_end, customers, mean, median) on "nice" bins: the smallest step of the form
    {1, 2, 5} x 10^k with span / step <= maxbins; bins start at floor(x / step) * step.  The mean and
    the median of all scores are the chart's markers, the same on every row."""
    x = scored.select(F.col(prob).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    span = F.col("span")
    power = F.concat(F.lit("1e"), F.floor(F.log10(span / maxbins)).cast("string")).cast("double")
    steps = F.array(*[F.lit(float(i)) * power for i in (1, 2, 5, 10, 20)])
    step = F.array_min(F.filter(steps, lambda s: span / s <= maxbins))
    st = (x.agg((F.max("x") - F.min("x")).alias("span"))
          .select(F.when(span > 0, step).otherwise(F.lit(1.0)).alias("step")))
    marks = exact_mean_std(x).select("mean").transform(attach(medians(x, ["x"]).select("median")))
    b = x.transform(attach(st)).withColumn("bin_start", F.floor(F.col("x") / F.col("step")) * F.col("step"))
    return (b.groupBy("bin_start", "step").agg(F.count(F.lit(1)).cast("bigint").alias("customers"))
            .transform(attach(marks))
            .select("bin_start", (F.col("bin_start") + F.col("step")).alias("bin_end"), "customers", "mean", "median"))


def risk_kpis(scored: DataFrame, threshold: float = 0.60, prob: str = "churn_probability") -> DataFrame:
    """One row: users, high_risk (probability >= threshold), mean and median probability."""
    p = F.col(prob)
    base = scored.agg(F.count(F.lit(1)).cast("bigint").alias("users"),
                      F.count_if(p >= threshold).cast("bigint").alias("high_risk"))
    mean = exact_mean_std(scored.select(p.cast("double").alias("x")).filter(F.col("x").isNotNull()))
    base = base.transform(attach(mean.select(F.col("mean").alias("mean_risk"))))
    med = medians(scored, [prob]).select(F.col("median").alias("median_risk"))
    return base.transform(attach(med))


def risk_ranking(scored: DataFrame, n: int | None = 20, prob: str = "churn_probability",
                 id_col: str = "customer_id") -> DataFrame:
    """Customers by descending probability (ties by id); ``n`` rows for the head view."""
    out = scored.orderBy(F.desc(prob), F.asc(id_col))
    return out.limit(n) if n is not None else out


def risk_ranking_all(scored: DataFrame, prob: str = "churn_probability", id_col: str = "customer_id") -> DataFrame:
    """Every customer with ``rank`` (1: the highest probability, ties by id, null probabilities last) and ``percentile``,
    the percentage of customers ranked below.

    Ranks come from range partitions and a prefix sum of their sizes (``pulse.functions.ranking``): no task sorts more
    than its range, where a window without partitions would sort all customers in one.
    """
    ranked = numbered(scored, [F.col(prob).desc_nulls_last(), F.col(id_col).asc_nulls_first()], out="_place")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    rank = F.col("_place") + 1
    return ranked.transform(attach(n)).select(
        *scored.columns, rank.alias("rank"), (F.lit(100.0) * (F.col("_n") - rank) / F.col("_n")).alias("percentile"))


def alerts_top_n(scored: DataFrame, run_ts, n: int = 500, prob: str = "churn_probability",
                 id_col: str = "customer_id") -> DataFrame:
    """Alert snapshot: the top ``n`` customers by risk with the run timestamp."""
    return (risk_ranking(scored, n, prob, id_col)
            .select(id_col, "city", "segment", "plan_type", prob,
                    F.lit(run_ts).cast("timestamp_ntz").alias("run_ts")))
