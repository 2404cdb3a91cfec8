"""Registered operations queries and their oracle SQL."""

from __future__ import annotations

from pulse.functions.filters import Dim
from pulse.operators import operations as ops
from pulse.plans.catalog import register
from pulse.plans.params import P1, P1_F0, P3_F3
from pulse.plans.sqltext import EVENTS_MART, N_ALL, N_DONE, N_GONE, SALES_MART, facts, part_of, with_mart

_SPEC_SHARE = P1_F0  # no lists: orders without a vendor stay and show as UNKNOWN category


def _counted(spec, key, mart=EVENTS_MART):
    """The three order counts by ``key``; orders of every status, with or without a vendor."""
    return with_mart(mart, facts(spec, vendors="LEFT JOIN", statuses=False),
                     f"SELECT {key}, {N_ALL}, {N_DONE}, {N_GONE} FROM bought GROUP BY ALL")


def _share_of(counted, value):
    return f"SELECT series, {value} AS value, {part_of(value, f'sum({value}) OVER ()')} AS share FROM ({counted})"


_DAYS = _counted(P1, "day")
_BY_CATEGORY = _counted(_SPEC_SHARE, "ifnull(category, 'UNKNOWN') AS series")
_RATES = f"""SELECT *, {part_of('orders_cancelled', 'orders_total')} AS cancel_rate,
  {part_of('orders_completed', 'orders_total')} AS fulfillment_rate FROM ({_DAYS})"""


@register("ops_timeseries", "operations", _DAYS, mart="events")
def ops_timeseries(m):
    return ops.ops_timeseries(m, P1)


@register("ops_timeseries_rates", "operations", _RATES, mart="events")
def ops_timeseries_rates(m):
    return ops.ops_timeseries_rates(m, P1)


@register("ops_share_by_dim", "operations", _BY_CATEGORY, mart="events")
def ops_share_by_dim(m):
    return ops.ops_share_by_dim(m, _SPEC_SHARE, Dim.CATEGORY)


@register("ops_share_by_status", "operations", _counted(P1, "ifnull(status, 'UNKNOWN') AS series"), mart="events")
def ops_share_by_status(m):
    return ops.ops_share_by_dim(m, P1, Dim.STATUS)


@register("ops_share_metric", "operations", _share_of(_BY_CATEGORY, "orders_cancelled"), mart="events")
def ops_share_metric(m):
    return ops.ops_share_metric(m, _SPEC_SHARE, "cancelled", Dim.CATEGORY)


@register("ops_share_total_only", "operations", with_mart(EVENTS_MART, facts(P1, vendors="LEFT JOIN", statuses=False), """
SELECT 'Total' AS series, count(*) AS value, least(count(*), 1)::DOUBLE AS share FROM bought"""), mart="events")
def ops_share_total_only(m):
    return ops.ops_share_metric(m, P1.replace(series_dim=Dim.NONE), "total", Dim.NONE)


@register("ops_share_summary", "operations", f"""
SELECT series, value AS total, round_even(share * 100, 1) AS share_pct
FROM ({_share_of(_BY_CATEGORY, 'orders_total')})""", mart="events")
def ops_share_summary(m):
    return ops.ops_share_summary(m, _SPEC_SHARE, "total", Dim.CATEGORY)


# one column a metric, turned into rows; the names are the source's fixed metric labels
@register("metrics_long", "operations", f"""
UNPIVOT (SELECT day, orders_total::DOUBLE AS "Órdenes", orders_completed::DOUBLE AS "Atendidas",
           orders_cancelled::DOUBLE AS "Canceladas", cancel_rate AS "Cancel rate", fulfillment_rate AS "Fulfillment"
         FROM ({_RATES}))
ON * EXCLUDE (day) INTO NAME metric VALUE value""", mart="events")
def metrics_long(m):
    return ops.metrics_long(m, P1)


@register("ops_timeseries_sales", "operations", _counted(P3_F3, "day", SALES_MART), mart="sales")
def ops_timeseries_sales(m):
    return ops.ops_timeseries(m, P3_F3)
