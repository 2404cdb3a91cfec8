"""Registered A/B queries (events stream) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulse.operators import experiments as ab
from pulse.plans.catalog import marts, register, tables
from pulse.plans.sqltext import EVENTS_MART, with_mart

_FACTS = """
facts AS (
  SELECT user_id, cast(ts AS date) AS day,
    count(*) FILTER (WHERE event_type = 'view') AS impressions,
    count(*) FILTER (WHERE event_type = 'click') AS clicks,
    count(*) FILTER (WHERE event_type = 'signup') AS add_to_cart,
    count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
    sum(CASE WHEN event_type = 'purchase' THEN cast(value AS decimal(18,2)) END) AS revenue
  FROM events GROUP BY 1, 2)"""


def _summary_select(keys: str) -> str:
    return f"""
SELECT {keys}, sessions, impressions, clicks, add_to_cart, purchases, orders,
  CASE WHEN impressions > 0 THEN cast(clicks AS double) / impressions ELSE 0.0 END AS ctr,
  CASE WHEN sessions > 0 THEN cast(add_to_cart AS double) / sessions ELSE 0.0 END AS add_to_cart_rate,
  CASE WHEN sessions > 0 THEN cast(purchases AS double) / sessions ELSE 0.0 END AS purchase_rate,
  cast(rev AS double) AS net_revenue,
  cast(rev * cast(0.3 AS decimal(2,1)) AS double) AS margin,
  CASE WHEN sessions > 0 THEN cast(rev AS double) / sessions ELSE 0.0 END AS revenue_per_session
FROM (
  SELECT {keys}, count(*) AS sessions, cast(sum(impressions) AS bigint) AS impressions,
    cast(sum(clicks) AS bigint) AS clicks, cast(sum(add_to_cart) AS bigint) AS add_to_cart,
    cast(sum(purchases) AS bigint) AS purchases, count(*) FILTER (WHERE purchases > 0) AS orders,
    coalesce(sum(revenue), 0) AS rev
  FROM f GROUP BY {keys}) a"""


_SUMMARY = f"""WITH {_FACTS.strip()},
f AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant FROM facts)
{_summary_select('variant')}"""


@register("ab_test_summary", "experiments", _SUMMARY)
def ab_test_summary(spark, sf_dir):
    return ab.ab_test_summary(tables(spark, sf_dir).events)


@register("ab_summary_by_dim", "experiments", with_mart(EVENTS_MART, _FACTS + """,
f AS (SELECT x.*, CASE WHEN x.user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, u.acquisition_channel AS dim
      FROM facts x LEFT JOIN mu u ON u.user_id = x.user_id)""", _summary_select("variant, dim")))
def ab_summary_by_dim(spark, sf_dir):
    return ab.ab_summary_by_dim(tables(spark, sf_dir).events, marts(spark, sf_dir, "events").users,
                                "acquisition_channel")


@register("ab_lift", "experiments", f"""
WITH s AS ({_SUMMARY}),
l AS (SELECT variant, 'ctr' AS metric, ctr AS value FROM s
      UNION ALL SELECT variant, 'add_to_cart_rate', add_to_cart_rate FROM s
      UNION ALL SELECT variant, 'purchase_rate', purchase_rate FROM s)
SELECT a.metric, a.value AS control, b.value AS treatment, b.value - a.value AS abs_lift,
  CASE WHEN a.value <> 0 THEN (b.value - a.value) / a.value ELSE 0.0 END AS rel_lift
FROM l a JOIN l b ON a.metric = b.metric AND a.variant = 'A' AND b.variant = 'B'""")
def ab_lift(spark, sf_dir):
    return ab.ab_lift(ab.ab_test_summary(tables(spark, sf_dir).events))


@register("ab_summary_by_device", "experiments", with_mart(EVENTS_MART, _FACTS + """,
f AS (SELECT x.*, CASE WHEN x.user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, u.device AS dim
      FROM facts x LEFT JOIN mu u ON u.user_id = x.user_id)""", _summary_select("variant, dim")))
def ab_summary_by_device(spark, sf_dir):
    return ab.ab_summary_by_dim(tables(spark, sf_dir).events, marts(spark, sf_dir, "events").users, "device")


@register("ab_summary_by_region", "experiments", with_mart(EVENTS_MART, _FACTS + """,
f AS (SELECT x.*, if(x.user_id % 2 = 0, 'A', 'B') AS variant, n_name AS dim
      FROM facts x LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON c_custkey = x.user_id)""",
                                                           _summary_select("variant, dim")))
def ab_summary_by_region(spark, sf_dir):
    t = tables(spark, sf_dir)
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"), F.col("n_name").alias("region"))
    return ab.ab_summary_by_dim(t.events, homes, "region")


# a session is a (user, day) with a product here: the part that the event's props name
@register("ab_summary_by_product", "experiments", f"""
WITH f AS (
  SELECT if(user_id % 2 = 0, 'A', 'B') AS variant, p_type AS dim,
    count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
    count(*) FILTER (event_type = 'signup') AS add_to_cart, count(*) FILTER (event_type = 'purchase') AS purchases,
    sum(value::DECIMAL(18,2)) FILTER (event_type = 'purchase') AS revenue
  FROM events LEFT JOIN part ON p_partkey = regexp_extract(props, '[0-9]+')::BIGINT
  GROUP BY user_id, ts::DATE, p_type)
{_summary_select("variant, dim")}""")
def ab_summary_by_product(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ab.ab_summary_by_product(t.events, t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("dim")))
