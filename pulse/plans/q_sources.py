"""Registered source queries: filter option lists of the events mart."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from pulse.functions.filters import Dim
from pulse.operators import acquisition as acq
from pulse.operators import catalog_ops, sales
from pulse.plans.catalog import register
from pulse.plans.params import P1, P3
from pulse.plans.sqltext import EVENTS_MART, FEES, GMV, N_ALL, N_DONE, N_GONE, SALES_MART, d, facts, part_of, with_mart

_OPTIONS = """
options AS (
  SELECT dimension, value FROM (SELECT city, acquisition_channel AS channel, device FROM mu)
    UNPIVOT INCLUDE NULLS (value FOR dimension IN (city, channel, device))
  UNION SELECT 'category', category FROM mv)"""


@register("filter_options", "sources", with_mart(EVENTS_MART, _OPTIONS, "SELECT DISTINCT dimension, value FROM options"), mart="events")
def filter_options(m):
    return catalog_ops.filter_options(m)


# lists are shown as text, for a comparison that knows scalars only
@register("option_lists", "sources", with_mart(EVENTS_MART, _OPTIONS, """
SELECT dimension, string_agg(DISTINCT value, '|' ORDER BY value) AS options, bool_or(value IS NULL) AS has_null
FROM options GROUP BY dimension"""), mart="events")
def option_lists(m):
    return catalog_ops.option_lists(m).select("dimension", F.array_join("values", "|").alias("options"), "has_null")


# a click on one bar restricts the next chart: the selected city replaces the city list
_CROSS = P1.cross_filter(Dim.CITY, ["BUILDING", "NOWHERE"])


@register("cross_filtered_users", "sources", with_mart(EVENTS_MART, facts(P1.replace(cities=("BUILDING",))), f"""
SELECT count_if(joined < {d(P1.date_from)})::BIGINT AS base_before,
  count_if(joined BETWEEN {d(P1.date_from)} AND {d(P1.date_to)})::BIGINT AS new_in_range, count(*) AS total_all FROM chosen"""), mart="events")
def cross_filtered_users(m):
    return acq.users_base_vs_new(m, _CROSS)


def _with_deleted(m):
    """The mart before its soft delete: every seventh order and every eleventh user carries a deletion time."""
    gone = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return dataclasses.replace(
        m, orders=m.orders.withColumn("deleted_at", F.when(F.col("order_id") % 7 == 0, gone)),
        users=m.users.withColumn("deleted_at", F.when(F.col("user_id") % 11 == 0, gone)))


@register("orders_kpis_soft_delete", "sources", with_mart(
    SALES_MART.replace("mu AS (", "all_users AS (", 1).replace("mo AS (", "mu AS (FROM all_users WHERE user_id % 11 <> 0),\nall_orders AS (", 1)
    + ",\nmo AS (FROM all_orders WHERE order_id % 7 <> 0)", facts(P3), f"""
SELECT *, {part_of('gmv', 'orders_completed')} AS aov, {part_of('orders_cancelled', 'orders_total')} AS cancel_rate
FROM (SELECT {N_ALL}, {N_DONE}, {N_GONE}, {GMV}, {FEES} FROM bought)"""), mart="sales")
def orders_kpis_soft_delete(m):
    return sales.orders_kpis(_with_deleted(m).live(), P3)
