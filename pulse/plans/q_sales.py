"""Registered sales queries and their oracle SQL."""

from __future__ import annotations

from calendar import monthrange

from pulse.functions.filters import Dim
from pulse.operators import sales, shares
from pulse.plans.catalog import register
from pulse.plans.params import P1, P3, P3_F3, P4
from pulse.plans.sqltext import EVENTS_MART, FEES, GMV, N_ALL, N_DONE, N_GONE, SALES_MART, d, facts, part_of, with_mart

# ---- flagship ------------------------------------------------------------------------------


def _kpi_sql(spec):
    first = spec.date_to.replace(day=1)
    last = first.replace(day=monthrange(first.year, first.month)[1])
    week = f"""
day_sizes AS (SELECT day, count(*) AS n FROM seen WHERE day BETWEEN {d(spec.date_from)} AND {d(spec.date_to)} GROUP BY day),
newest AS (SELECT unnest(list_slice(list(n ORDER BY day DESC), 1, 7)) AS n FROM day_sizes),
fresh AS (
  SELECT c.user_id, coalesce(bool_or(o.order_date::DATE - c.joined <= 7), false) AS bought_soon
  FROM chosen c LEFT JOIN mo o USING (user_id)
  WHERE c.joined BETWEEN {d(spec.date_from)} AND {d(spec.date_to)} GROUP BY c.user_id),
parts AS (
  SELECT * FROM (SELECT coalesce(avg(n), 0) AS dau FROM newest),
    (SELECT count(DISTINCT user_id)::DOUBLE AS mau FROM seen WHERE day BETWEEN {d(first)} AND {d(last)}),
    (SELECT count(*) AS new_users, {part_of('count_if(bought_soon)', 'count(*)')} AS activation FROM fresh),
    (SELECT {N_ALL}, {N_DONE}, {N_GONE}, {GMV}, {FEES} FROM bought))"""
    return with_mart(EVENTS_MART, facts(spec) + "," + week, f"""
SELECT dau AS dau_7d_avg, mau, {part_of('dau', 'mau')} AS stickiness, new_users, activation AS activation_7d,
  orders_total, orders_completed, orders_cancelled, {part_of('orders_cancelled', 'orders_total')} AS cancel_rate,
  gmv, {part_of('gmv', 'orders_completed')} AS aov, commission
FROM parts""")


@register("kpi_summary", "sales", _kpi_sql(P1), mart="events")
def kpi_summary(m):
    return sales.kpi_summary(m, P1)


@register("kpi_summary_empty_range", "sales", _kpi_sql(P4), mart="events")
def kpi_summary_empty_range(m):
    return sales.kpi_summary(m, P4)


# ---- order KPIs and daily sales (sales mart) -------------------------------------------------

def _bought(spec, select, more="", **how):
    """``select`` over the sales mart's ``bought`` (and further CTEs ``more``)."""
    return with_mart(SALES_MART, facts(spec, **how) + ("," + more if more else ""), select)


def _orders_kpis_sql(spec):
    return _bought(spec, f"""
SELECT *, {part_of('gmv', 'orders_completed')} AS aov, {part_of('orders_cancelled', 'orders_total')} AS cancel_rate
FROM (SELECT {N_ALL}, {N_DONE}, {N_GONE}, {GMV}, {FEES} FROM bought)""")


@register("orders_kpis", "sales", _orders_kpis_sql(P3), mart="sales")
def orders_kpis(m):
    return sales.orders_kpis(m, P3)


@register("orders_kpis_filtered", "sales", _orders_kpis_sql(P3_F3), mart="sales")
def orders_kpis_filtered(m):
    return sales.orders_kpis(m, P3_F3)


@register("sales_timeseries", "sales", _bought(P3, f"SELECT day, {GMV}, {N_ALL}, {N_DONE}, {N_GONE} FROM bought GROUP BY day"),
          mart="sales")
def sales_timeseries(m):
    return sales.sales_timeseries(m, P3)


@register("sales_timeseries_rates", "sales", _bought(P3, f"""
SELECT day, {GMV}, {N_ALL}, {N_DONE}, {N_GONE}, avg((status = 'cancelled')::INT) AS cancel_rate FROM bought GROUP BY day"""),
          mart="sales")
def sales_timeseries_rates(m):
    return sales.sales_timeseries_rates(m, P3)


# ---- top-K ------------------------------------------------------------------------------------

def _first(n, order):
    return f"QUALIFY row_number() OVER (ORDER BY {order}) <= {n}"


_TOP_CITIES = _bought(P3, f"""
SELECT city, {GMV}, count(*) AS orders FROM bought GROUP BY city {_first(10, 'gmv DESC, city NULLS LAST')}""")
_TOP_VENDORS = f"""
SELECT vendor_id, any_value(vendor_city) AS city, any_value(category) AS category, any_value(rating) AS rating,
  {GMV}, count(*) AS orders
FROM bought GROUP BY vendor_id {_first(15, 'gmv DESC, vendor_id')}"""


@register("top_cities_gmv", "sales", _TOP_CITIES, mart="sales")
def top_cities_gmv(m):
    return sales.top_cities_gmv(m, P3)


@register("top_vendors_gmv", "sales", _bought(P3, _TOP_VENDORS), mart="sales")
def top_vendors_gmv(m):
    return sales.top_vendors_gmv(m, P3)


@register("top_categories_from_vendors", "sales", _bought(P3, """
SELECT category, sum(gmv) AS gmv, sum(orders)::BIGINT AS orders FROM best GROUP BY category""",
                                                          f"best AS ({_TOP_VENDORS})"), mart="sales")
def top_categories_from_vendors(m):
    return sales.top_categories_from_vendors(m, P3)


@register("top_categories_gmv", "sales", _bought(P3_F3, f"""
SELECT category, {GMV}, count(*) AS orders FROM bought GROUP BY category"""), mart="sales")
def top_categories_gmv(m):
    return sales.top_categories_gmv(m, P3_F3)


def _top10_sql(spec, column):
    """The ten best values of a column; all statuses are read, completed orders count."""
    return _bought(spec, f"""
SELECT ifnull({column}, 'UNKNOWN') AS dim, {GMV}, count(paid) AS orders
FROM bought GROUP BY dim {_first(10, 'gmv DESC, dim')}""", vendors="LEFT JOIN", statuses=False)


@register("top10_gmv_by_dim", "sales", _top10_sql(P3, "channel"), mart="sales")
def top10_gmv_by_dim(m):
    return sales.top10_gmv_by_dim(m, P3, Dim.CHANNEL)


@register("top10_gmv_by_status", "sales", _top10_sql(P3_F3, "status"), mart="sales")
def top10_gmv_by_status(m):
    return sales.top10_gmv_by_dim(m, P3_F3, Dim.STATUS)


@register("top10_gmv_by_category", "sales", _top10_sql(P3, "category"), mart="sales")
def top10_gmv_by_category(m):
    return sales.top10_gmv_by_dim(m, P3, Dim.CATEGORY)


@register("gmv_share_top10", "sales", f"""
SELECT dim AS series, gmv, {part_of('gmv', 'sum(gmv) OVER ()')} AS share FROM ({_top10_sql(P3, 'channel')})""", mart="sales")
def gmv_share_top10(m):
    top = sales.top10_gmv_by_dim(m, P3, Dim.CHANNEL)
    return shares.with_share(top.select(top["dim"].alias("series"), "gmv"), "gmv")


@register("compare_orders_by_dim", "sales", _bought(P3, f"""
SELECT category AS dim, {GMV}, {N_ALL}, {N_GONE}, {FEES} FROM bought GROUP BY dim"""), mart="sales")
def compare_orders_by_dim(m):
    return sales.compare_orders_by_dim(m, P3, Dim.CATEGORY)


# a city's rank comes from its whole-range sum; a NULL city may take a rank but has no line of its own
@register("compare_orders_trend_top5", "sales", _bought(P3, """
SELECT day, dim, gmv, orders_total, orders_cancelled, commission FROM daily JOIN ranked USING (dim) WHERE place <= 5""", f"""
daily AS (SELECT day, city AS dim, {GMV}, {N_ALL}, {N_GONE}, {FEES} FROM bought GROUP BY day, dim),
ranked AS (SELECT city AS dim, row_number() OVER (ORDER BY coalesce(sum(paid), 0) DESC, city NULLS LAST) AS place
           FROM bought GROUP BY city)"""), mart="sales")
def compare_orders_trend_top5(m):
    return sales.compare_orders_trend_top5(m, P3, Dim.CITY)


@register("share_top8_others", "sales", _bought(P3, """
SELECT if(place <= 8, vendor_city, 'Otros') AS series, sum(n) / any_value(whole) AS share, sum(n) AS value
FROM sized GROUP BY if(place <= 8, place, 9), series""", """
sized AS (SELECT vendor_city, count(*)::DOUBLE AS n, (sum(count(*)) OVER ())::DOUBLE AS whole,
            row_number() OVER (ORDER BY count(*) DESC, vendor_city NULLS LAST) AS place
          FROM bought GROUP BY vendor_city)"""), mart="sales")
def share_top8_others(m):
    by_vendor_city = sales.order_base(m, P3).groupBy("v_city").count()
    return shares.share_top_n_others(by_vendor_city, "count", "v_city", 8)


@register("share_centre_total", "sales", _bought(P3, "SELECT count(*)::DOUBLE AS total FROM bought"), mart="sales")
def share_centre_total(m):
    return shares.centre_total(share_top8_others(m))


@register("normalize_top", "sales", f"SELECT ifnull(city, 'None') AS dim, gmv, orders FROM ({_TOP_CITIES})", mart="sales")
def normalize_top(m):
    return shares.normalize_top(sales.top_cities_gmv(m, P3), preferred_dim_col="city")
