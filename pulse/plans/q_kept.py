"""Registered queries over grouping sets and over state that is kept and merged: rollups, sketches, runs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from pulse.operators import cube, rollups
from pulse.operators import sketches as sk
from pulse.operators.churn.features import ID, last_order_score
from pulse.operators.churn.runs import compare_latest, record_scores
from pulse.plans.catalog import register, tables
from pulse.plans.params import CHURN_AS_OF, P1, P1_F0
from pulse.plans.q_churn import PREV_AS_OF, RETRAIN, RUN_TS, SCORED_CTE, _prev_scores_sql, _scored, _stats_sql
from pulse.plans.sqltext import EVENTS_MART, FEES, GMV, N_ALL, N_DONE, N_GONE, d, facts, with_mart
from pulse.session import new_folder, written
from pulse.sources.runs import RunStore

# ---- grouping sets -----------------------------------------------------------------------------------
_NAMES = "ifnull(city, 'UNKNOWN') AS c, ifnull(channel, 'UNKNOWN') AS h, ifnull(device, 'UNKNOWN') AS v"
_DIMS = "coalesce(c, 'Total') AS city, coalesce(h, 'Total') AS channel, coalesce(v, 'Total') AS device"


def _cubed(spec, rows, measures, more=""):
    return with_mart(EVENTS_MART, facts(spec) + more, f"SELECT {_DIMS}, {measures} FROM (SELECT *, {_NAMES} FROM {rows}) GROUP BY CUBE (c, h, v)")


@register("orders_cube", "sales", _cubed(P1, "bought", ", ".join([N_ALL, N_DONE, N_GONE, GMV, FEES])), mart="events")
def orders_cube(m):
    return cube.orders_cube(m, P1)


@register("new_users_cube", "acquisition", _cubed(P1, f"(FROM chosen WHERE joined BETWEEN {d(P1.date_from)} AND {d(P1.date_to)})", "count(*) AS new_users"),
          mart="events")
def new_users_cube(m):
    return cube.new_users_cube(m, P1)


_SEEN = f"(FROM seen JOIN chosen USING (user_id) WHERE day BETWEEN {d(P1.date_from)} AND {d(P1.date_to)})"


@register("active_users_cube", "activation", _cubed(P1_F0, _SEEN, "count(DISTINCT user_id) AS active_users, count(*) AS user_days"), mart="events")
def active_users_cube(m):
    return cube.active_users_cube(m, P1_F0)


@register("dau_with_totals", "activation", with_mart(EVENTS_MART, facts(P1_F0), f"""
SELECT day, {_DIMS}, count(DISTINCT user_id) AS dau FROM (SELECT *, {_NAMES} FROM {_SEEN})
GROUP BY GROUPING SETS ((day), (day, c), (day, h), (day, v))"""), mart="events")
def dau_with_totals(m):
    return cube.dau_with_totals(m, P1_F0)


# ---- rollups under changes ---------------------------------------------------------------------------
# A batch of changes on the orders of early January, derived from their ids: statuses that change, orders that move to another
# day, orders deleted, and late orders under new ids. An order can be in several; its last version counts.
_UNTIL = date(2024, 1, 10)


def _changes(orders):
    some = orders.where(F.to_date("order_date") < F.lit(_UNTIL)).select(*rollups.COLUMNS)
    at = F.col("order_date")
    day = F.expr("INTERVAL 1 DAY")
    kinds = [(97, {"order_status": F.lit("completed")}, at + day, False), (89, {"order_date": at + day * 3}, at + day * 2, False),
             (101, {}, at + day * 3, True), (83, {"order_id": F.col("order_id") + 10_000_000_000, "order_date": at - day}, at, False)]
    out = None
    for every, new, changed, deleted in kinds:
        rows = some.where(F.col("order_id") % every == 0).withColumns({"changed_at": changed, "deleted": F.lit(deleted)}).withColumns(new)
        out = rows if out is None else out.unionByName(rows)
    return out


@register("rollup_after_changes", "operations", with_mart(EVENTS_MART, f"""
early AS (FROM mo WHERE order_date::DATE < {d(_UNTIL)}),
changes AS (
  SELECT * REPLACE ('completed' AS order_status), order_date + INTERVAL 1 DAY AS changed, false AS gone FROM early WHERE order_id % 97 = 0
  UNION ALL SELECT * REPLACE (order_date + INTERVAL 3 DAY AS order_date), order_date + INTERVAL 2 DAY, false FROM early WHERE order_id % 89 = 0
  UNION ALL SELECT *, order_date + INTERVAL 3 DAY, true FROM early WHERE order_id % 101 = 0
  UNION ALL SELECT * REPLACE (order_id + 10000000000 AS order_id, order_date - INTERVAL 1 DAY AS order_date), order_date, false FROM early WHERE order_id % 83 = 0),
now AS (
  FROM (SELECT * EXCLUDE (changed, gone) FROM changes QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY changed DESC) = 1 AND NOT gone)
  UNION ALL FROM mo WHERE order_id NOT IN (SELECT order_id FROM changes)),
counted AS (SELECT order_date::DATE AS day, order_status AS status, CASE order_status WHEN 'completed' THEN order_total END AS paid,
                   CASE order_status WHEN 'completed' THEN commission END AS fee FROM now)""",
          f"SELECT day, {N_ALL}, {N_DONE}, {N_GONE}, {GMV}, {FEES} FROM counted GROUP BY day"), mart="events")
def rollup_after_changes(m):
    path = new_folder(m.spark)
    rollups.build(m.orders, path)
    rollups.apply_changes(m.orders, _changes(m.orders), path)
    return rollups.read(m.spark, path).select("day", "orders_total", "orders_completed", "orders_cancelled", "gmv", "commission")


# ---- sketches ----------------------------------------------------------------------------------------
# Estimates are not SQL's to state: a *_digest beside each says the exact number and whether the estimate keeps its bound.
_JAN = (date(2024, 1, 1), date(2024, 1, 31))
_LINES = """
named AS (
  SELECT user_id, day, unnest(['total', 'city', 'channel', 'device']) AS dim,
         unnest(['Total', ifnull(city, 'UNKNOWN'), ifnull(channel, 'UNKNOWN'), ifnull(device, 'UNKNOWN')]) AS series
  FROM seen JOIN chosen USING (user_id))"""


@register("active_users_hll", "activation", None, mart="events")
def active_users_hll(m):
    kept = written(sk.day_user_sketches(m, P1_F0, *_JAN))
    exact = cube.active_users_cube(m, P1_F0.replace(date_from=_JAN[0], date_to=_JAN[1]))
    total, dims = F.lit("Total"), ("city", "channel", "device")
    named = [F.when(F.col(x) != total, F.lit(x)) for x in dims]
    exact = exact.where(sum(((F.col(x) != total).cast("int") for x in dims), F.lit(0)) <= 1)
    exact = exact.select(F.coalesce(*named, F.lit("total")).alias("dim"), F.coalesce(*[F.when(F.col(x) != total, F.col(x)) for x in dims], total).alias("series"), "active_users")
    return exact.join(sk.estimated_users(kept, *_JAN), ["dim", "series"], "left").withColumn("std_error", F.col("active_users") * sk.hll_error())


@register("active_users_hll_digest", "activation", with_mart(EVENTS_MART, facts(P1_F0) + "," + _LINES, f"""
SELECT dim, series, count(DISTINCT user_id) AS active_users, true AS within_3_errors FROM named WHERE day BETWEEN {d(_JAN[0])} AND {d(_JAN[1])} GROUP BY ALL"""),
          mart="events")
def active_users_hll_digest(m):
    return active_users_hll(m).select("dim", "series", "active_users",
                                      (F.abs(F.col("estimate") - F.col("active_users")) <= 3 * F.col("std_error") + 1).alias("within_3_errors"))


_WEEK1, _WEEK3 = (date(2024, 1, 1), date(2024, 1, 7)), (date(2024, 1, 15), date(2024, 1, 21))


@register("returning_users_theta", "activation", None, mart="events")
def returning_users_theta(m):
    kept = written(sk.window_sketches(m, P1_F0, [("one", *_WEEK1), ("two", *_WEEK3)]))
    found = sk.overlaps(kept, "one", "two").withColumnRenamed("both", "estimate")
    return sk.exact_overlaps(m, P1_F0, _WEEK1, _WEEK3).join(found, ["dim", "series"], "left")


@register("returning_users_theta_digest", "activation", with_mart(EVENTS_MART, facts(P1_F0) + "," + _LINES + f""",
per_user AS (SELECT dim, series, user_id, bool_or(day BETWEEN {d(_WEEK1[0])} AND {d(_WEEK1[1])}) AS a, bool_or(day BETWEEN {d(_WEEK3[0])} AND {d(_WEEK3[1])}) AS b
             FROM named WHERE day BETWEEN {d(_WEEK1[0])} AND {d(_WEEK3[1])} GROUP BY ALL)""", """
SELECT dim, series, count_if(a AND b) AS both, true AS within_3_errors FROM per_user GROUP BY ALL"""), mart="events")
def returning_users_theta_digest(m):
    union = F.coalesce(F.col("users_one") + F.col("users_two") - F.col("estimate"), F.lit(0))
    error = 3 * union / F.sqrt(F.lit(2.0**sk.THETA_LG_K)) + 1
    return returning_users_theta(m).select("dim", "series", "both", (F.abs(F.coalesce("estimate", F.lit(0)) - F.col("both")) <= error).alias("within_3_errors"))


_SHARES, _SCORE_K = (0.05, 0.25, 0.5, 0.75, 0.95), 400


@register("score_quantiles_kll", "churn", None)
def score_quantiles_kll(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    cells = written(scored.groupBy("segment", "plan_type").agg(F.kll_sketch_agg_double("churn_probability", F.lit(_SCORE_K)).alias("scores")))
    found = written(sk.quantiles(cells, ["segment"], _SHARES), 1)
    return sk.exact_ranks(scored, found, "segment", "churn_probability")


@register("score_quantiles_kll_digest", "churn", f"""WITH {SCORED_CTE}
SELECT segment, unnest({list(_SHARES)!r})::DOUBLE AS q, n, true AS within_bound FROM (SELECT segment, count(*) AS n FROM sc GROUP BY segment)""")
def score_quantiles_kll_digest(spark, sf_dir):
    slack = 2 * sk.kll_rank_error(_SCORE_K) * F.col("n") + 1
    rank = F.col("q") * F.col("n")
    return score_quantiles_kll(spark, sf_dir).select(
        "segment", "q", "n", ((F.col("below") <= rank + slack) & (F.col("up_to") >= rank - slack)).alias("within_bound"))


# ---- runs --------------------------------------------------------------------------------------------
@register("retrain_vs_previous", "churn", f"""WITH {SCORED_CTE},
cur AS (FROM sc WHERE list_contains({RETRAIN['segment']!r}, segment)),
prv AS ({_prev_scores_sql(PREV_AS_OF)}),
{_stats_sql('cur', 'c_').strip()},
{_stats_sql('prv', 'p_').strip()},
cl AS (UNPIVOT (SELECT mean, median, mode, std, min, max, cast(count AS double) AS count FROM c_st)
       ON mean, median, mode, std, min, max, count INTO NAME metric VALUE current),
pl AS (UNPIVOT (SELECT mean, median, mode, std, min, max, cast(count AS double) AS count FROM p_st)
       ON mean, median, mode, std, min, max, count INTO NAME metric VALUE previous)
SELECT metric, current, previous, 'now' AS current_run, 'before' AS previous_run, 'segment=mid,high' AS current_filters, '' AS previous_filters
FROM cl FULL JOIN pl USING (metric)""")
def retrain_vs_previous(spark, sf_dir):
    store = RunStore(spark, new_folder(spark))
    record_scores(store, "before", RUN_TS - timedelta(days=(CHURN_AS_OF - PREV_AS_OF).days), last_order_score(tables(spark, sf_dir), PREV_AS_OF), {})
    scored = _scored(spark, sf_dir)
    record_scores(store, "now", RUN_TS, scored.where(F.col("segment").isin(RETRAIN["segment"])).select(ID, "segment", "churn_probability"), RETRAIN)
    return compare_latest(store, RUN_TS)
