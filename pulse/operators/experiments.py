"""A/B test summaries over an event stream.

Definitions (the source names the metrics only; these choices are ours):
a session is a (user, day); impressions, clicks, add-to-cart and purchases are event
counts by type; an order is a session with at least one purchase; net revenue sums
purchase values; margin is a fixed share of net revenue; ctr = clicks / impressions,
add_to_cart_rate = add_to_cart / sessions, purchase_rate = purchases / sessions,
revenue_per_session = net_revenue / sessions.

Plan: events are first collapsed to one row per (user, day) (map-side partial
aggregation), only then joined to the user dimension and grouped by variant.  No
fact is joined before it is aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import ratio

# Fixed event-type mapping and margin rate of the A/B fixture.
IMPRESSION, CLICK, ADD_TO_CART, PURCHASE = "view", "click", "signup", "purchase"
MARGIN_RATE = "0.3"

AB_METRICS = ["sessions", "impressions", "clicks", "add_to_cart", "purchases", "orders",
              "ctr", "add_to_cart_rate", "purchase_rate", "net_revenue", "margin", "revenue_per_session"]


def variant_of(user_id) -> F.Column:
    """Deterministic assignment: even user ids see A, odd ids see B."""
    return F.when(F.col(user_id) % 2 == 0, F.lit("A")).otherwise(F.lit("B"))


def session_facts(events: DataFrame, *keys: str) -> DataFrame:
    """One row per (user_id, day) and ``keys`` with event counts and decimal revenue."""
    t = F.col("event_type")
    return (events.select("user_id", F.to_date("ts").alias("day"), *keys, "event_type",
                          F.col("value").cast("decimal(18,2)").alias("value"))
            .groupBy("user_id", "day", *keys)
            .agg(F.count_if(t == IMPRESSION).alias("impressions"),
                 F.count_if(t == CLICK).alias("clicks"),
                 F.count_if(t == ADD_TO_CART).alias("add_to_cart"),
                 F.count_if(t == PURCHASE).alias("purchases"),
                 F.sum(F.when(t == PURCHASE, F.col("value"))).alias("revenue")))


def _summary(facts: DataFrame, keys: list) -> DataFrame:
    agg = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("sessions"),
        F.sum("impressions").cast("bigint").alias("impressions"),
        F.sum("clicks").cast("bigint").alias("clicks"),
        F.sum("add_to_cart").cast("bigint").alias("add_to_cart"),
        F.sum("purchases").cast("bigint").alias("purchases"),
        F.count_if(F.col("purchases") > 0).cast("bigint").alias("orders"),
        F.coalesce(F.sum("revenue"), F.lit(0).cast("decimal(28,2)")).alias("rev"))
    return agg.select(
        *keys, "sessions", "impressions", "clicks", "add_to_cart", "purchases", "orders",
        ratio("clicks", "impressions").alias("ctr"),
        ratio("add_to_cart", "sessions").alias("add_to_cart_rate"),
        ratio("purchases", "sessions").alias("purchase_rate"),
        F.col("rev").cast("double").alias("net_revenue"),
        (F.col("rev") * F.lit(MARGIN_RATE).cast("decimal(2,1)")).cast("double").alias("margin"),
        ratio(F.col("rev").cast("double"), "sessions").alias("revenue_per_session"))


def ab_test_summary(events: DataFrame) -> DataFrame:
    """Per variant: the A/B metrics."""
    facts = session_facts(events).withColumn("variant", variant_of("user_id"))
    return _summary(facts, ["variant"])


def ab_summary_by_dim(events: DataFrame, users: DataFrame, dim_col: str) -> DataFrame:
    """Per (variant, dimension value): the A/B metrics; the dimension comes from the users table."""
    facts = session_facts(events).withColumn("variant", variant_of("user_id"))
    u = users.select("user_id", F.col(dim_col).alias("dim"))
    return _summary(facts.join(u, "user_id", "left"), ["variant", "dim"])


def ab_summary_by_product(events: DataFrame, products: DataFrame, id_pattern: str = "[0-9]+") -> DataFrame:
    """Per (variant, product dimension): a session is a (user, day) with that dimension's value.

    The product is named in the event's ``props``; ``products`` (product_id, dim) is met after events
    are reduced to (user, day, product).  Their counts are additive, so the second aggregate is exact.
    """
    named = events.withColumn("product_id", F.regexp_extract("props", id_pattern, 0).try_cast("bigint"))
    facts = session_facts(named, "product_id").join(products, "product_id", "left")
    per_dim = facts.groupBy("user_id", "day", "dim").agg(
        *[F.sum(c).alias(c) for c in ("impressions", "clicks", "add_to_cart", "purchases", "revenue")])
    return _summary(per_dim.withColumn("variant", variant_of("user_id")), ["variant", "dim"])


LIFT_METRICS = ["ctr", "add_to_cart_rate", "purchase_rate"]


def ab_lift(summary: DataFrame, control: str = "A", treatment: str = "B") -> DataFrame:
    """(metric, control, treatment, abs_lift, rel_lift) for the rate metrics.

    ``unpivot`` then a pivot on the two known variants: a two-row input, no self join
    of facts.  rel_lift is 0.0 when the control rate is 0.
    """
    long = summary.unpivot(["variant"], LIFT_METRICS, "metric", "value")
    wide = long.groupBy("metric").pivot("variant", [control, treatment]).agg(F.first("value"))
    a, b = F.col(control), F.col(treatment)
    return wide.select("metric", a.alias("control"), b.alias("treatment"), (b - a).alias("abs_lift"),
                       F.when(a != 0, (b - a) / a).otherwise(F.lit(0.0)).alias("rel_lift"))
