"""Registered churn queries: feature table, preprocessing and risk metrics (SQL-checkable on
the deterministic score), plus the model queries (Spark ML) with digests that SQL can check."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from pulse.operators.churn import metrics as cm
from pulse.operators.churn import model as cmodel
from pulse.operators.churn import prep
from pulse.operators.churn.features import (CATEGORICAL, EVENTS_AS_OF, ID, LABEL, NUMERIC, churn_features,
                                             churn_history, deterministic_score)
from pulse.plans.catalog import cached, register, tables
from pulse.session import materialize, written
from pulse.plans.params import (CHURN_AS_OF, CHURN_LABEL_DAYS, CHURN_LONG_DAYS, CHURN_SHORT_DAYS,
                                HIGH_RISK_THRESHOLD)

PREV_AS_OF = date(1999, 7, 1)
RUN_TS = datetime(2000, 1, 1, 6, 0, 0)


def _features(spark, sf_dir, as_of=CHURN_AS_OF):
    """The churn feature table, materialised once per application and data folder.

    Every churn query reads it (the source application loads its feature view once
    and caches it); it is checkpointed to the cluster's checkpoint folder when one
    is configured, else persisted.
    """
    return cached(spark, sf_dir, f"churn_features_{as_of.isoformat()}", lambda: materialize(
        churn_features(tables(spark, sf_dir), as_of, CHURN_SHORT_DAYS, CHURN_LONG_DAYS, CHURN_LABEL_DAYS)))


def _scored(spark, sf_dir, as_of=CHURN_AS_OF):
    return deterministic_score(_features(spark, sf_dir, as_of))


def _ts(d: date) -> str:
    return f"timestamp '{d.isoformat()} 00:00:00'"


def _features_sql(as_of: date) -> str:
    s30 = _ts(as_of - timedelta(days=30))
    s90 = _ts(as_of - timedelta(days=CHURN_SHORT_DAYS))
    s365 = _ts(as_of - timedelta(days=CHURN_LONG_DAYS))
    lab = _ts(as_of + timedelta(days=CHURN_LABEL_DAYS))
    a = _ts(as_of)
    return f"""
SELECT c.c_custkey AS customer_id,
  CASE WHEN c.c_custkey % 50 <> 0 THEN c.c_mktsegment END AS city,
  CASE WHEN c.c_acctbal < 0 THEN 'low' WHEN c.c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS segment,
  CASE c.c_custkey % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'plus' ELSE 'pro' END AS plan_type,
  cast(c.c_custkey % 2 AS bigint) AS has_mobile_app,
  coalesce(e.events_7d, 0) AS events_7d, coalesce(e.events_30d, 0) AS events_30d,
  coalesce(t.tx_30d, 0) AS tx_30d, coalesce(t.tx_90d, 0) AS tx_90d, coalesce(t.tx_365d, 0) AS tx_365d,
  coalesce(t.revenue_365d, cast(0 AS double)) AS revenue_365d,
  t.revenue_365d / nullif(t.tx_365d, 0) AS aov_365d,
  t.days_since_last_tx,
  l.avg_discount_365d, coalesce(l.tickets_365d, 0) AS tickets_365d,
  cast(CASE WHEN f.customer_id IS NULL THEN 1 ELSE 0 END AS int) AS churn
FROM customer c
LEFT JOIN (
  SELECT o_custkey AS customer_id,
    count(CASE WHEN o_orderdate > {s30} THEN 1 END) AS tx_30d,
    count(CASE WHEN o_orderdate > {s90} THEN 1 END) AS tx_90d,
    count(CASE WHEN o_orderdate > {s365} THEN 1 END) AS tx_365d,
    cast(sum(CASE WHEN o_orderdate > {s365} THEN cast(o_totalprice AS decimal(18,2)) END) AS double) AS revenue_365d,
    cast(date_diff('day', cast(max(o_orderdate) AS date), DATE '{as_of.isoformat()}') AS bigint) AS days_since_last_tx
  FROM orders WHERE o_orderdate <= {a} GROUP BY o_custkey) t ON t.customer_id = c.c_custkey
LEFT JOIN (
  SELECT o.o_custkey AS customer_id,
    cast(sum(cast(l_discount AS decimal(9,4))) AS double) / count(*) AS avg_discount_365d,
    count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS tickets_365d
  FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey
  WHERE o_orderdate <= {a} AND o_orderdate > {s365}
  GROUP BY o.o_custkey) l ON l.customer_id = c.c_custkey
LEFT JOIN (
  SELECT DISTINCT o_custkey AS customer_id FROM orders
  WHERE o_orderdate > {a} AND o_orderdate <= {lab}) f
  ON f.customer_id = c.c_custkey
LEFT JOIN (
  SELECT user_id AS customer_id, count(*) AS events_30d, count_if(ts > {_ts(EVENTS_AS_OF - timedelta(days=7))}) AS events_7d
  FROM events WHERE ts <= {_ts(EVENTS_AS_OF)} AND ts > {_ts(EVENTS_AS_OF - timedelta(days=30))} GROUP BY 1) e
  ON e.customer_id = c.c_custkey"""


FEATURES_SQL = _features_sql(CHURN_AS_OF)
def _idle(days: str) -> str:
    return f"coalesce(round({days}::DOUBLE / ({days} + 365)::DOUBLE, 9), 0::DOUBLE) AS churn_probability"


_SCORE = _idle("days_since_last_tx")
SCORED_CTE = f"f AS ({FEATURES_SQL}),\nsc AS (SELECT *, {_SCORE} FROM f)"
_NUM_LONG = "\nUNION ALL ".join(f"SELECT '{c}' AS feature, cast({c} AS double) AS value FROM f" for c in NUMERIC)
_CAT_LONG = "\nUNION ALL ".join(f"SELECT '{c}' AS feature, cast({c} AS varchar) AS value FROM f" for c in CATEGORICAL)
_MEDIANS = f"""
nl AS ({_NUM_LONG}),
nr AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn,
         count(*) OVER (PARTITION BY feature) AS n FROM nl WHERE value IS NOT NULL),
med AS (SELECT feature, (min(value) + max(value)) / 2 AS median FROM nr
        WHERE rn = (n + 1) // 2 OR rn = n // 2 + 1 GROUP BY feature)"""
_MODES = f"""
cl AS ({_CAT_LONG}),
cc AS (SELECT feature, value, count(*) AS n FROM cl WHERE value IS NOT NULL GROUP BY 1, 2),
modes AS (SELECT feature, value AS mode FROM (
  SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC) AS rn FROM cc) x
  WHERE rn = 1)"""
_IMPUTED = ",\n".join([
    f"imp AS (SELECT customer_id, churn, "
    + ", ".join(f"coalesce(cast({c} AS double), (SELECT median FROM med WHERE feature = '{c}')) AS {c}" for c in NUMERIC)
    + ", "
    + ", ".join(f"coalesce(cast({c} AS varchar), (SELECT mode FROM modes WHERE feature = '{c}')) AS {c}"
                for c in CATEGORICAL)
    + " FROM f)"])
_SPLIT = """
sp AS (SELECT *, row_number() OVER (PARTITION BY churn ORDER BY substr(md5(cast(customer_id AS varchar) || '|42'), 1, 15),
         customer_id) AS _rn, count(*) OVER (PARTITION BY churn) AS _n FROM sc),
split AS (SELECT * EXCLUDE (_rn, _n), _rn <= round(cast(0.2 AS double) * _n) AS is_test FROM sp)"""


@register("churn_features", "churn", FEATURES_SQL)
def q_churn_features(spark, sf_dir):
    return _features(spark, sf_dir)


#: Month ends of 1999, each with an as-of date of the event stream.
HISTORY = [(date(1999 + m // 12, m % 12 + 1, 1) - timedelta(days=1), EVENTS_AS_OF - timedelta(days=2 * (12 - m))) for m in range(1, 13)]


def _history_sql() -> str:
    """Each as-of date by itself: every window counted from the raw facts."""
    since = lambda n, of="as_of": f"o_orderdate <= {of} AND o_orderdate > {of} - INTERVAL {n} DAY"
    return f"""
WITH dates(as_of, ev) AS (VALUES {', '.join(f"({_ts(a)}, {_ts(e)})" for a, e in HISTORY)}),
lines AS (SELECT l_orderkey, sum(l_discount::DECIMAL(9,4)) AS discount, count(*) AS n, count_if(l_returnflag = 'R') AS returned
          FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT as_of, o_custkey AS customer_id, count(*) FILTER ({since(30)}) AS tx_30d, count(*) FILTER ({since(90)}) AS tx_90d,
    coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER ({since(90)}), 0)::DOUBLE AS revenue_90d,
    sum(discount) FILTER ({since(90)}) AS discount, sum(lines.n) FILTER ({since(90)}) AS n,
    coalesce(sum(returned) FILTER ({since(60)}), 0)::BIGINT AS tickets_60d,
    date_diff('day', max(o_orderdate) FILTER (o_orderdate <= as_of)::DATE, as_of::DATE) AS days_since_last_tx,
    count_if(o_orderdate > as_of) AS later
  FROM dates JOIN orders ON o_orderdate <= as_of + INTERVAL 30 DAY LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY as_of, o_custkey),
e AS (
  SELECT as_of, user_id AS customer_id, count(*) FILTER (ts > ev - INTERVAL 7 DAY) AS events_7d, count(*) AS events_30d
  FROM dates JOIN events ON ts <= ev AND ts > ev - INTERVAL 30 DAY GROUP BY as_of, user_id)
SELECT d.as_of::DATE AS as_of, c_custkey AS customer_id, if(c_custkey % 50 <> 0, c_mktsegment, NULL) AS city,
  CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS segment,
  ['basic', 'plus', 'pro'][c_custkey % 3 + 1] AS plan_type, c_custkey % 2 AS has_mobile_app,
  coalesce(events_7d, 0) AS events_7d, coalesce(events_30d, 0) AS events_30d, coalesce(tx_30d, 0) AS tx_30d, coalesce(tx_90d, 0) AS tx_90d,
  coalesce(revenue_90d, 0::DOUBLE) AS revenue_90d, revenue_90d / nullif(tx_90d, 0) AS aov_90d, discount::DOUBLE / nullif(n, 0)::BIGINT AS avg_discount_90d,
  coalesce(tickets_60d, 0) AS tickets_60d, days_since_last_tx, if(coalesce(later, 0) > 0, 0, 1) AS churn
FROM customer CROSS JOIN dates d LEFT JOIN o ON o.as_of = d.as_of AND o.customer_id = c_custkey
  LEFT JOIN e ON e.as_of = d.as_of AND e.customer_id = c_custkey"""


@register("churn_features_history", "churn", _history_sql())
def q_churn_features_history(spark, sf_dir):
    return churn_history(tables(spark, sf_dir), HISTORY)


@register("churn_rate_history", "churn", f"""
SELECT as_of, segment, count(*) AS customers, sum(churn)::BIGINT AS churned, count(days_since_last_tx) AS with_orders,
  sum(tx_90d)::BIGINT AS tx_90d FROM ({_history_sql()}) GROUP BY ALL""")
def q_churn_rate_history(spark, sf_dir):
    return (churn_history(tables(spark, sf_dir), HISTORY).groupBy("as_of", "segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(LABEL).cast("bigint").alias("churned"),
        F.count("days_since_last_tx").alias("with_orders"), F.sum("tx_90d").alias("tx_90d")))


@register("impute_numeric_median", "churn", f"WITH f AS ({FEATURES_SQL}),{_MEDIANS}\nSELECT feature, median FROM med")
def q_impute_numeric_median(spark, sf_dir):
    return prep.numeric_medians(_features(spark, sf_dir), NUMERIC)


@register("impute_categorical_mode", "churn", f"WITH f AS ({FEATURES_SQL}),{_MODES}\nSELECT feature, mode FROM modes")
def q_impute_categorical_mode(spark, sf_dir):
    return prep.categorical_modes(_features(spark, sf_dir), CATEGORICAL)


@register("churn_imputed", "churn", f"WITH f AS ({FEATURES_SQL}),{_MEDIANS},{_MODES},\n{_IMPUTED}\nSELECT * FROM imp")
def q_churn_imputed(spark, sf_dir):
    f = _features(spark, sf_dir)
    return prep.impute(f.select(ID, LABEL, *NUMERIC, *CATEGORICAL), NUMERIC, CATEGORICAL)


@register("one_hot", "churn", f"""WITH f AS ({FEATURES_SQL}),{_MODES}
SELECT customer_id, c.feature || '=' || coalesce(c.value, mode) AS feature, 1::DOUBLE AS value
FROM (SELECT customer_id, unnest({[f"{c}" for c in CATEGORICAL]!r}) AS feature, unnest([{', '.join(CATEGORICAL)}]) AS value FROM f) c
JOIN modes USING (feature)""")
def q_one_hot(spark, sf_dir):
    imp = prep.impute(_features(spark, sf_dir).select(ID, LABEL, *CATEGORICAL), [], CATEGORICAL)
    return prep.one_hot_long(imp, ID, CATEGORICAL, prep.vocabulary(imp, CATEGORICAL))


@register("stratified_split", "churn", f"WITH {SCORED_CTE},{_SPLIT}\nSELECT customer_id, churn, is_test FROM split")
def q_stratified_split(spark, sf_dir):
    return prep.stratified_split(_features(spark, sf_dir), ID, LABEL).select(ID, LABEL, "is_test")


@register("class_weights", "churn", f"""WITH {SCORED_CTE},{_SPLIT},
tr AS (SELECT churn, count(*) AS n FROM split WHERE NOT is_test GROUP BY 1)
SELECT churn, n, cast((SELECT sum(n) FROM tr) AS double) / ((SELECT count(*) FROM tr) * n) AS weight FROM tr""")
def q_class_weights(spark, sf_dir):
    split = prep.stratified_split(_features(spark, sf_dir), ID, LABEL)
    return prep.class_weights(split.filter(~split["is_test"]), LABEL)


def _test_scored(spark, sf_dir):
    sc = prep.stratified_split(_scored(spark, sf_dir), ID, LABEL)
    return sc.filter(sc["is_test"])


_TEST = f"WITH {SCORED_CTE},{_SPLIT},\nts AS (SELECT * FROM split WHERE is_test)"


@register("roc_auc", "churn", _TEST + """,
rk AS (SELECT churn, rank() OVER (ORDER BY churn_probability) AS r,
         count(*) OVER (PARTITION BY churn_probability) AS t FROM ts)
SELECT CASE WHEN sum(churn) > 0 AND sum(1 - churn) > 0 THEN
  cast(sum(CASE WHEN churn = 1 THEN 2 * r + t - 1 ELSE 0 END) - sum(churn) * (sum(churn) + 1) AS double)
  / (2.0 * sum(churn) * sum(1 - churn)) ELSE cast('nan' AS double) END AS roc_auc
FROM rk""")
def q_roc_auc(spark, sf_dir):
    return cm.roc_auc(_test_scored(spark, sf_dir))


_CONF = """,
cf AS (SELECT count(*) FILTER (WHERE churn = 1 AND churn_probability >= 0.5) AS tp,
              count(*) FILTER (WHERE churn <> 1 AND churn_probability >= 0.5) AS fp,
              count(*) FILTER (WHERE churn = 1 AND churn_probability < 0.5) AS fn,
              count(*) FILTER (WHERE churn <> 1 AND churn_probability < 0.5) AS tn FROM ts)"""


@register("f1_at_half", "churn", _TEST + _CONF + """
SELECT CASE WHEN tp + fn = 0 OR fp + tn = 0 THEN cast('nan' AS double)
            WHEN 2 * tp + fp + fn > 0 THEN cast(2 * tp AS double) / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM cf""")
def q_f1_at_half(spark, sf_dir):
    return cm.f1_at_half(_test_scored(spark, sf_dir))


def _div(n, d):
    return f"CASE WHEN ({d}) > 0 THEN cast({n} AS double) / ({d}) ELSE 0.0 END"


@register("classification_report", "churn", _TEST + _CONF + f""",
m AS (SELECT {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1, {_div('2 * tp', '2 * tp + fp + fn')} AS f1,
             {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0, {_div('2 * tn', '2 * tn + fn + fp')} AS f0,
             tp + fn AS n1, tn + fp AS n0, tp + fn + tn + fp AS n, {_div('tp + tn', 'tp + fn + tn + fp')} AS acc FROM cf)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, cast(n0 AS bigint) AS support FROM m
UNION ALL SELECT '1', p1, r1, f1, n1 FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM m
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m
UNION ALL SELECT 'weighted avg', (p1 * n1 + p0 * n0) / n, (r1 * n1 + r0 * n0) / n, (f1 * n1 + f0 * n0) / n, n FROM m""")
def q_classification_report(spark, sf_dir):
    return cm.classification_report(_test_scored(spark, sf_dir))


def _stats_sql(src: str, p: str = "") -> str:
    """CTEs {p}x, {p}xr, {p}xm, {p}xmode, {p}st: distribution stats of churn_probability in ``src``."""
    return f"""
{p}x AS (SELECT churn_probability AS x FROM {src} WHERE churn_probability IS NOT NULL),
{p}xr AS (SELECT x, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n FROM {p}x),
{p}xm AS (SELECT (min(x) + max(x)) / 2 AS median FROM {p}xr WHERE rn = (n + 1) // 2 OR rn = n // 2 + 1),
{p}xmode AS (SELECT v AS mode FROM (SELECT round_even(x, 3) AS v, count(*) AS c FROM {p}x GROUP BY 1) t
          ORDER BY c DESC, v ASC LIMIT 1),
{p}xmean AS (SELECT cast(sum(cast(x AS decimal(38,18))) AS double) / count(*) AS mean FROM {p}x),
{p}st AS (SELECT (SELECT mean FROM {p}xmean) AS mean, (SELECT median FROM {p}xm) AS median,
         (SELECT mode FROM {p}xmode) AS mode,
         CASE WHEN count(*) > 1 THEN sqrt(cast(sum(cast((x - (SELECT mean FROM {p}xmean)) * (x - (SELECT mean FROM {p}xmean))
              AS decimal(38,18))) AS double) / (count(*) - 1)) ELSE 0.0 END AS std,
         min(x) AS min, max(x) AS max, count(*) AS count FROM {p}x)"""


@register("risk_distribution_stats", "churn", f"WITH {SCORED_CTE},{_stats_sql('sc')}\nSELECT * FROM st WHERE count > 0")
def q_risk_distribution_stats(spark, sf_dir):
    return cm.risk_distribution_stats(_scored(spark, sf_dir))


def _prev_scores_sql(as_of: date) -> str:
    return f"""
SELECT c_custkey AS customer_id, {_idle(f"date_diff('day', t.last_tx::DATE, DATE '{as_of.isoformat()}')")}
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_tx FROM orders
                         WHERE o_orderdate <= {_ts(as_of)} GROUP BY 1) t ON t.o_custkey = c_custkey"""


@register("risk_stats_vs_previous", "churn", f"""WITH
cur AS ({_prev_scores_sql(CHURN_AS_OF)}),
prv AS ({_prev_scores_sql(PREV_AS_OF)}),
{_stats_sql('cur', 'c_').strip()},
{_stats_sql('prv', 'p_').strip()},
cl AS (UNPIVOT (SELECT mean, median, mode, std, min, max, cast(count AS double) AS count FROM c_st)
       ON mean, median, mode, std, min, max, count INTO NAME metric VALUE current),
pl AS (UNPIVOT (SELECT mean, median, mode, std, min, max, cast(count AS double) AS count FROM p_st)
       ON mean, median, mode, std, min, max, count INTO NAME metric VALUE previous)
SELECT coalesce(cl.metric, pl.metric) AS metric, cl.current, pl.previous
FROM cl FULL JOIN pl ON cl.metric = pl.metric""")
def q_risk_stats_vs_previous(spark, sf_dir):
    t = tables(spark, sf_dir)
    from pulse.operators.churn.features import last_order_score
    return cm.risk_stats_vs_previous(last_order_score(t, CHURN_AS_OF), last_order_score(t, PREV_AS_OF))


# the smallest of 1, 2, 5, 10 times the power of ten below span / 28 that needs no more than 28 bins
@register("risk_histogram", "churn", f"""WITH {SCORED_CTE},
rng AS (SELECT max(churn_probability) - min(churn_probability) AS span FROM sc),
stp AS (SELECT CASE WHEN span > 0 THEN list_min(list_filter(
          [m * ('1e' || floor(log10(span / 28))::INT)::DOUBLE FOR m IN [1, 2, 5, 10, 20]], lambda s: span / s <= 28)) ELSE 1.0 END AS step
        FROM rng),
{_stats_sql('sc').strip()}
SELECT floor(churn_probability / step) * step AS bin_start, floor(churn_probability / step) * step + step AS bin_end,
  count(*) AS customers, any_value(mean) AS mean, any_value(median) AS median
FROM sc CROSS JOIN stp CROSS JOIN st WHERE churn_probability IS NOT NULL GROUP BY 1, 2""")
def q_risk_histogram(spark, sf_dir):
    return cm.risk_histogram(_scored(spark, sf_dir))


@register("risk_kpis", "churn", f"""WITH {SCORED_CTE},{_stats_sql('sc')}
SELECT count(*) AS users, count(*) FILTER (WHERE churn_probability >= {HIGH_RISK_THRESHOLD}) AS high_risk,
  (SELECT mean FROM xmean) AS mean_risk, (SELECT median FROM xm) AS median_risk FROM sc""")
def q_risk_kpis(spark, sf_dir):
    return cm.risk_kpis(_scored(spark, sf_dir), HIGH_RISK_THRESHOLD)


@register("risk_ranking", "churn", f"""WITH {SCORED_CTE}
SELECT * FROM sc ORDER BY churn_probability DESC, customer_id ASC LIMIT 20""")
def q_risk_ranking(spark, sf_dir):
    return cm.risk_ranking(_scored(spark, sf_dir), 20)


@register("risk_ranking_all", "churn", f"""WITH {SCORED_CTE}
SELECT customer_id, city, segment, plan_type, churn, churn_probability,
  row_number() OVER (ORDER BY churn_probability DESC, customer_id) AS rank,
  100.0::DOUBLE * (count(*) OVER () - row_number() OVER (ORDER BY churn_probability DESC, customer_id)) / count(*) OVER () AS percentile
FROM sc""")
def q_risk_ranking_all(spark, sf_dir):
    return cm.risk_ranking_all(_scored(spark, sf_dir).select(ID, "city", "segment", "plan_type", LABEL, "churn_probability"))


@register("alerts_top_n", "churn", f"""WITH {SCORED_CTE}
SELECT customer_id, city, segment, plan_type, churn_probability, TIMESTAMP '{RUN_TS.isoformat(sep=' ')}' AS run_ts
FROM sc ORDER BY churn_probability DESC, customer_id ASC LIMIT 500""")
def q_alerts_top_n(spark, sf_dir):
    return cm.alerts_top_n(_scored(spark, sf_dir), RUN_TS, 500)


# ---- Spark ML ---------------------------------------------------------------------------------
# The forest has the source's 500 trees and no depth limit but Spark's 30. Trees are not SQL: the model queries return
# their whole results, which tests/test_model_queries.py recomputes with numpy; beside each, a *_digest of the same frame
# keeps what the tables alone decide (who is scored, counts, members of the split), which its oracle states.
ML_TREES, ML_DEPTH, ML_REPEATS = 500, 30, 5
RETRAIN = {"segment": ["mid", "high"], "city": []}
_FITTED: dict = {}


def _kept(spark, sf_dir, name, build):
    """A fitted model, or a frame of one, kept for the application: a fit takes minutes."""
    key = (spark.sparkContext.applicationId, sf_dir, name, ML_TREES, ML_DEPTH)
    if key not in _FITTED:
        _FITTED[key] = build()
    return _FITTED[key]


def _model(spark, sf_dir):
    return _kept(spark, sf_dir, "model", lambda: cmodel.train_forest(
        _features(spark, sf_dir), NUMERIC, CATEGORICAL, LABEL, ID, num_trees=ML_TREES, max_depth=ML_DEPTH))


def _model_scores(spark, sf_dir):
    """Every customer's score, written once: 500 trees are walked once for ranking, digests and exports."""
    return _kept(spark, sf_dir, "scores", lambda: written(cmodel.score(_model(spark, sf_dir), _features(spark, sf_dir))))


def _retrained(spark, sf_dir):
    return _kept(spark, sf_dir, "retrained", lambda: cmodel.retrain_on_filter(
        _features(spark, sf_dir), RETRAIN, num_cols=NUMERIC, cat_cols=CATEGORICAL, label_col=LABEL, id_col=ID,
        num_trees=ML_TREES, max_depth=ML_DEPTH))[1]


def _importance(spark, sf_dir):
    def build():
        split = prep.stratified_split(_features(spark, sf_dir), ID, LABEL)
        test = split.filter(split["is_test"]).drop("is_test")
        return written(cmodel.permutation_importance(_model(spark, sf_dir), test, n_repeats=ML_REPEATS), 1)
    return _kept(spark, sf_dir, "importance", build)


def _sizes(where: str = "true") -> str:
    """Rows of the split of the features that pass ``where``: round(n / 5) of each class are held out."""
    return f"""SELECT sum(n)::BIGINT AS n_all, sum(floor(0.2 * n + 0.5))::BIGINT AS n_test
FROM (SELECT churn, count(*)::DOUBLE AS n FROM ({FEATURES_SQL}) WHERE {where} GROUP BY churn)"""


@register("train_metrics", "churn", None)
def q_train_metrics(spark, sf_dir):
    return cmodel.train_metrics(spark, _model(spark, sf_dir))


@register("train_metrics_digest", "churn", f"SELECT n_all - n_test AS n_train, n_test FROM ({_sizes()})")
def q_train_metrics_digest(spark, sf_dir):
    return q_train_metrics(spark, sf_dir).select("n_train", "n_test")


@register("score_customers", "churn", None)
def q_score_customers(spark, sf_dir):
    return _model_scores(spark, sf_dir)


@register("score_customers_digest", "churn", f"""
SELECT customer_id, city, segment, plan_type, churn, true AS score_in_range FROM ({FEATURES_SQL})""")
def q_score_customers_digest(spark, sf_dir):
    return _model_scores(spark, sf_dir).select(ID, "city", "segment", "plan_type", LABEL, F.col("churn_probability").between(0, 1).alias("score_in_range"))


@register("model_risk_ranking", "churn", None)
def q_model_risk_ranking(spark, sf_dir):
    return cm.risk_ranking_all(_model_scores(spark, sf_dir))


@register("model_risk_ranking_digest", "churn", f"""
SELECT rank, 100.0::DOUBLE * (n - rank) / n AS percentile FROM (SELECT count(*) AS n FROM ({FEATURES_SQL})), (SELECT unnest(range(1, n + 1)) AS rank)""")
def q_model_risk_ranking_digest(spark, sf_dir):
    return q_model_risk_ranking(spark, sf_dir).select("rank", "percentile")


@register("feature_importance", "churn", None)
def q_feature_importance(spark, sf_dir):
    return _importance(spark, sf_dir)


@register("feature_importance_digest", "churn", f"SELECT unnest({[*NUMERIC, *CATEGORICAL]!r}) AS feature, true AS is_finite")
def q_feature_importance_digest(spark, sf_dir):
    return _importance(spark, sf_dir).select("feature", (F.abs("importance") < float("inf")).alias("is_finite"))


@register("retrain_on_filter", "churn", None)
def q_retrain_on_filter(spark, sf_dir):
    return _retrained(spark, sf_dir)


@register("retrain_on_filter_digest", "churn", f"""
SELECT n_all AS n_rows, n_all - n_test AS n_train, n_test, 'segment=mid,high' AS filters
FROM ({_sizes("list_contains(['mid', 'high'], segment)")})""")
def q_retrain_on_filter_digest(spark, sf_dir):
    return _retrained(spark, sf_dir).select((F.col("n_train") + F.col("n_test")).alias("n_rows"), "n_train", "n_test", "filters")
