"""Churn feature table: one row per customer as of a date, with a future-window label.

Features use only orders on or before the as-of date; the label looks strictly after
it (no leakage).  Window lengths are parameters (the source's names suggest 7/30/60/90
days; the fixture uses 90/365 days and a 180-day label horizon, see FIXTURES.md).

Plan: each source is aggregated per customer with conditional aggregates (map-side
partial aggregation, so a customer with a third of all orders costs one buffer per
task), then left-joined to the customer base on the customer key.  Lineitems are
joined to the orders of the long window before their aggregate.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.sources.tables import Tables

CATEGORICAL = ["city", "segment", "plan_type"]
NUMERIC = ["has_mobile_app", "events_7d", "events_30d", "tx_30d", "tx_90d", "tx_365d", "revenue_365d", "aov_365d", "days_since_last_tx",
           "avg_discount_365d", "tickets_365d"]
LABEL = "churn"
#: The event stream of the fixture lies elsewhere in time than its orders; it has an as-of date of its own.
EVENTS_AS_OF = date(2024, 1, 31)
ID = "customer_id"


def _ts(d: date):
    return F.lit(datetime(d.year, d.month, d.day)).cast("timestamp_ntz")


def churn_features(t: Tables, as_of: date, short_days: int = 90, long_days: int = 365,
                   label_days: int = 180, events_as_of: date = EVENTS_AS_OF) -> DataFrame:
    """customer_id, city, segment, plan_type, has_mobile_app, events_7d, events_30d, tx_30d, tx_90d, tx_365d, revenue_365d,
    aov_365d, days_since_last_tx, avg_discount_365d, tickets_365d, churn."""
    asof = _ts(as_of)
    month_start = _ts(as_of - timedelta(days=30))
    short_start = _ts(as_of - timedelta(days=short_days))
    long_start = _ts(as_of - timedelta(days=long_days))
    label_end = _ts(as_of + timedelta(days=label_days))
    od = F.col("o_orderdate")

    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    past = od <= asof
    tx = (orders.filter(od <= label_end).groupBy(F.col("o_custkey").alias(ID)).agg(
        F.count_if(past & (od > month_start)).alias("tx_30d"),
        F.count_if(past & (od > short_start)).alias("tx_90d"),
        F.count_if(past & (od > long_start)).alias("tx_365d"),
        F.sum(F.when(past & (od > long_start), F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("revenue_365d"),
        F.datediff(F.lit(as_of), F.to_date(F.max(F.when(past, od)))).cast("bigint").alias("days_since_last_tx"),
        F.count_if(~past).alias("_later")))
    seen = (t.events.filter((F.col("ts") <= _ts(events_as_of)) & (F.col("ts") > _ts(events_as_of - timedelta(days=30))))
            .groupBy(F.col("user_id").alias(ID)).agg(
                F.count_if(F.col("ts") > _ts(events_as_of - timedelta(days=7))).alias("events_7d"),
                F.count(F.lit(1)).alias("events_30d")))

    # Lineitems are joined to the long-window orders first (broadcast when that set is
    # small; otherwise the orders' date filter becomes a runtime bloom filter on the
    # lineitem scan), then aggregated per customer with a map-side partial aggregate.
    recent = orders.filter((od <= asof) & (od > long_start)).select("o_orderkey", "o_custkey")
    lines = (t.lineitem.select("l_orderkey", "l_discount", "l_returnflag")
             .join(recent, F.col("l_orderkey") == F.col("o_orderkey"))
             .groupBy(F.col("o_custkey").alias(ID)).agg(
                 (F.sum(F.col("l_discount").cast("decimal(9,4)")).cast("double") / F.count(F.lit(1)))
                 .alias("avg_discount_365d"),
                 F.count_if(F.col("l_returnflag") == "R").alias("tickets_365d")))

    c = t.customer.select(F.col("c_custkey").alias(ID), "c_mktsegment", "c_acctbal")
    k = F.col(ID)
    base = c.select(
        ID,
        F.when(k % 50 != 0, F.col("c_mktsegment")).alias("city"),
        F.when(F.col("c_acctbal") < 0, "low").when(F.col("c_acctbal") < 5000, "mid").otherwise("high").alias("segment"),
        F.when(k % 3 == 0, "basic").when(k % 3 == 1, "plus").otherwise("pro").alias("plan_type"),
        (k % 2).cast("bigint").alias("has_mobile_app"))
    out = base.join(tx, ID, "left").join(lines, ID, "left").join(seen, ID, "left")
    return out.select(
        ID, "city", "segment", "plan_type", "has_mobile_app",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("events_7d", "events_30d", "tx_30d")],
        F.coalesce("tx_90d", F.lit(0)).cast("bigint").alias("tx_90d"),
        F.coalesce("tx_365d", F.lit(0)).cast("bigint").alias("tx_365d"),
        F.coalesce("revenue_365d", F.lit(0.0)).alias("revenue_365d"),
        (F.col("revenue_365d") / F.when(F.col("tx_365d") != 0, F.col("tx_365d"))).alias("aov_365d"),
        "days_since_last_tx", "avg_discount_365d",
        F.coalesce("tickets_365d", F.lit(0)).cast("bigint").alias("tickets_365d"),
        F.when(F.col("_later") > 0, 0).otherwise(1).cast("int").alias(LABEL))


HISTORY_TX, HISTORY_EVENTS = (30, 90), (7, 30)
HISTORY_SPEND, HISTORY_TICKETS = 90, 60


def _number(day) -> F.Column:
    return F.unix_date(day)


def _counts_on(ts: str) -> F.Column:
    """The first midnight by which ``ts`` is past: what happens at midnight sharp counts on that day, as in ``ts <= as_of``."""
    return F.date_add(F.to_date(F.col(ts) - F.expr("INTERVAL 1 MICROSECOND")), 1)


def churn_history(t: Tables, as_ofs: list[tuple[date, date]], label_days: int = 30) -> DataFrame:
    """Features and label of every customer at many as-of dates, from one pass over each fact.

    ``as_ofs``: (as-of date, as-of date of the event stream). One row for each customer and as-of date: as_of,
    customer_id, city, segment, plan_type, has_mobile_app, events_7d, events_30d, tx_30d, tx_90d, revenue_90d, aov_90d,
    avg_discount_90d, tickets_60d, days_since_last_tx, churn (no order in the ``label_days`` after the date).

    Facts become one cell per customer and day. Cells and as-of markers are sorted by day within a customer, and
    each window length is a range frame over that one sort: a further as-of date costs a marker row per customer,
    not a scan. A customer has at most one cell a day, so a customer with a third of all orders is a short run.
    """
    dates, ev_dates = [a for a, _ in as_ofs], [e for _, e in as_ofs]
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(F.col("l_discount").cast("decimal(9,4)")).alias("discount"), F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    orders = t.orders.where(F.col("o_orderdate") <= _ts(max(dates) + timedelta(days=label_days))).select(
        "o_orderkey", F.col("o_custkey").alias(ID), "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("paid"))
    cells = (orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(ID, _counts_on("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("tx"), F.sum("paid").alias("paid"), F.sum("discount").alias("discount"), F.sum("lines").alias("lines"),
        F.sum("returned").alias("returned"), F.max("o_orderdate").alias("last")))
    seen = (t.events.where((F.col("ts") <= _ts(max(ev_dates))) & (F.col("ts") > _ts(min(ev_dates) - timedelta(days=max(HISTORY_EVENTS)))))
            .groupBy(F.col("user_id").alias(ID), _counts_on("ts").alias("day")).agg(F.count(F.lit(1)).alias("events")))

    k = F.col(ID)
    base = t.customer.select(
        F.col("c_custkey").alias(ID), F.when(F.col("c_custkey") % 50 != 0, F.col("c_mktsegment")).alias("city"),
        F.when(F.col("c_acctbal") < 0, "low").when(F.col("c_acctbal") < 5000, "mid").otherwise("high").alias("segment")).withColumn(
        "plan_type", F.when(k % 3 == 0, "basic").when(k % 3 == 1, "plus").otherwise("pro")).withColumn("has_mobile_app", (k % 2).cast("bigint"))
    pairs = F.array(*[F.struct(F.lit(a).alias("as_of"), F.lit(e).alias("ev_day")) for a, e in as_ofs])
    marks = base.withColumn("_m", F.explode(pairs)).select("*", "_m.as_of", "_m.ev_day").drop("_m")

    def back(days):  # the window (as_of - days, as_of]
        return Window.partitionBy(ID).orderBy("_n").rangeBetween(1 - days, 0)

    ever = Window.partitionBy(ID).orderBy("_n").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(ID).orderBy("_n").rangeBetween(1, label_days)
    spend, tickets = back(HISTORY_SPEND), back(HISTORY_TICKETS)
    laid = marks.withColumn("day", F.col("as_of")).unionByName(cells, allowMissingColumns=True).withColumn("_n", _number("day"))
    with_tx = laid.select(
        *marks.columns, *[F.coalesce(F.sum("tx").over(back(d)), F.lit(0)).alias(f"tx_{d}d") for d in HISTORY_TX],
        F.coalesce(F.sum("paid").over(spend).cast("double"), F.lit(0.0)).alias("revenue_90d"), F.sum("discount").over(spend).alias("_discount"),
        F.sum("lines").over(spend).alias("_lines"), F.coalesce(F.sum("returned").over(tickets), F.lit(0)).alias("tickets_60d"),
        F.max("last").over(ever).alias("_last"), F.coalesce(F.sum("tx").over(later), F.lit(0)).alias("_later")).where(F.col("as_of").isNotNull())
    laid = with_tx.withColumn("day", F.col("ev_day")).unionByName(seen, allowMissingColumns=True).withColumn("_n", _number("day"))
    done = laid.select(*with_tx.columns, *[F.coalesce(F.sum("events").over(back(d)), F.lit(0)).alias(f"events_{d}d") for d in HISTORY_EVENTS])
    return done.where(F.col("as_of").isNotNull()).select(
        "as_of", ID, "city", "segment", "plan_type", "has_mobile_app",
        *[F.col(c).cast("bigint").alias(c) for c in ("events_7d", "events_30d", "tx_30d", "tx_90d")], "revenue_90d",
        (F.col("revenue_90d") / F.when(F.col("tx_90d") > 0, F.col("tx_90d"))).alias("aov_90d"),
        (F.col("_discount").cast("double") / F.when(F.col("_lines") > 0, F.col("_lines"))).alias("avg_discount_90d"),
        F.col("tickets_60d").cast("bigint").alias("tickets_60d"),
        F.datediff("as_of", F.to_date("_last")).cast("bigint").alias("days_since_last_tx"),
        F.when(F.col("_later") > 0, 0).otherwise(1).cast("int").alias(LABEL))


def idle_score(days) -> F.Column:
    """A model-free risk score for checks: d / (d + 365) of the days since the last order.

    It rises strictly with d and has no cap; without any order there is no idle time: 0.
    """
    d = days.cast("double")
    return F.coalesce(F.round(d / (d + 365.0), 9), F.lit(0.0))


def deterministic_score(features: DataFrame) -> DataFrame:
    return features.withColumn("churn_probability", idle_score(F.col("days_since_last_tx")))


def last_order_score(t: Tables, as_of: date) -> DataFrame:
    """(customer_id, churn_probability) of the deterministic score as of a date: a scored snapshot."""
    last = (t.orders.filter(F.col("o_orderdate") <= _ts(as_of))
            .groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_tx")))
    days = F.datediff(F.lit(as_of), F.to_date("last_tx")).cast("bigint")
    return (t.customer.select(F.col("c_custkey").alias(ID))
            .join(last, F.col(ID) == F.col("o_custkey"), "left")
            .select(ID, idle_score(days).alias("churn_probability")))
