"""Registered activation/engagement queries (events mart) and their oracle SQL."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

from pulse.functions.filters import Dim
from pulse.operators import activation as act
from pulse.operators import activity_bitmaps as bits
from pulse.operators import intervals
from pulse.operators.acquisition import period_bars
from pulse.plans.catalog import register
from pulse.plans.params import P1, P1_CAT, P1_F0, P2, P4
from pulse.session import written
from pulse.plans.sqltext import EVENTS_MART, d, days, facts, one_of, part_of, with_mart

D1, D2 = P1.date_from, P1.date_to
EXT_START = D1 - timedelta(days=P1.days * 6)


def _on_facts(spec, select, more=""):
    return with_mart(EVENTS_MART, facts(spec) + ("," + more if more else ""), select)


def _within(a, b, day="day"):
    return f"{day} >= {d(a)} AND {day} <= {d(b)}"


def _in_range(spec):
    return _within(spec.date_from, spec.date_to)


@register("dau_daily", "activation", _on_facts(P1, f"SELECT day, count(*) AS dau FROM seen WHERE {_in_range(P1)} GROUP BY day"),
          mart="events")
def dau_daily(m):
    return act.dau_daily(m, P1)


# every day once, with as many matches as users were seen
@register("dau_daily_extended", "activation", _on_facts(P1, f"""
SELECT day, count(user_id) AS dau FROM ({days(EXT_START, D2)}) LEFT JOIN seen USING (day) GROUP BY day"""), mart="events")
def dau_daily_extended(m):
    return act.dau_daily_extended(m, P1, EXT_START, D2)


def _week(spec):
    """One row: the mean of the last seven days that have anyone."""
    return f"""
week AS (SELECT coalesce(list_avg(list_slice(list(n ORDER BY day DESC), 1, 7)), 0) AS dau_7d_avg
         FROM (SELECT day, count(*) AS n FROM seen WHERE {_in_range(spec)} GROUP BY day))"""


def _month(spec):
    """One row: users seen in the calendar month of the range's last day, also after it."""
    first = spec.date_to.replace(day=1)
    last = first.replace(day=monthrange(first.year, first.month)[1])
    return f"""
month AS (SELECT count(DISTINCT user_id) AS mau FROM seen WHERE {_within(first, last)})"""


@register("dau_7d_avg", "activation", _on_facts(P1, "FROM week", _week(P1)), mart="events")
def dau_7d_avg(m):
    return act.dau_7d_avg(m, P1)


@register("mau", "activation", _on_facts(P2, "FROM month", _month(P2)), mart="events")
def mau(m):
    return act.mau(m, P2)


@register("stickiness", "activation", _on_facts(P2, f"""
SELECT dau_7d_avg, mau, {part_of('dau_7d_avg', 'mau')} AS stickiness FROM week, month""", _week(P2) + "," + _month(P2)),
          mart="events")
def stickiness(m):
    return act.stickiness(m, P2)


# users of the range with an order, of any status and however early, at most 7 days after signup
@register("activation_7d", "activation", _on_facts(P1, f"""
SELECT {part_of('count_if(soon)', 'count(*)')} AS activation_7d
FROM (SELECT EXISTS (FROM mo WHERE mo.user_id = c.user_id AND mo.order_date < c.joined + INTERVAL 8 DAY) AS soon
      FROM chosen c WHERE {_within(D1, D2, 'joined')})"""), mart="events")
def activation_7d(m):
    return act.activation_7d(m, P1)


_PD1, _PD2 = P1.previous_window()


@register("active_users_vs_prev", "activation", _on_facts(P1, f"""
SELECT total_users_all, active_users, active_users_prev, {part_of('active_users', 'total_users_all')} AS share_active,
  coalesce(now_days / now_dates, 0) AS avg_dau, {d(_PD1)} AS prev_d1, {d(_PD2)} AS prev_d2,
  active_users - active_users_prev AS delta_abs,
  CASE WHEN active_users_prev > 0 THEN (active_users - active_users_prev)::DOUBLE / active_users_prev
       ELSE least(active_users, 1)::DOUBLE END AS delta_pct,
  greatest(total_users_all - active_users, 0) AS inactive_users
FROM (SELECT count(*) AS total_users_all FROM chosen), windows""", f"""
windows AS (
  SELECT count(DISTINCT user_id) FILTER ({_within(D1, D2)}) AS active_users,
    count(DISTINCT user_id) FILTER ({_within(_PD1, _PD2)}) AS active_users_prev,
    count(*) FILTER ({_within(D1, D2)}) AS now_days,
    nullif(count(DISTINCT day) FILTER ({_within(D1, D2)}), 0) AS now_dates
  FROM seen)"""),
          mart="events")
def active_users_vs_prev(m):
    return act.active_users_vs_prev(m, P1)


def _binned(spec, start, end, period, listed):
    """Users seen in each period that begins by ``end``; with user lists, only periods in which anyone was."""
    periods = (end - start).days // period + 1
    number = f"(day - {d(start)}) // {period}"
    source = "seen" if listed else "(SELECT user_id, session_date::DATE AS day FROM ms)"
    counted = f"""
counted AS (SELECT {number} AS no, count(DISTINCT user_id) AS n FROM {source}
            WHERE day >= {d(start)} AND {number} < {periods} GROUP BY no)"""
    return _on_facts(spec, f"""
SELECT {d(start)} + (no * {period})::INT AS day, coalesce(n, 0) AS value
FROM {'counted' if listed else f'range({periods}) AS r(no) LEFT JOIN counted USING (no)'}""", counted)


_BINS = _binned(P1, EXT_START, D2, P1.days, listed=True)


@register("active_users_by_bins", "activation", _BINS, mart="events")
def active_users_by_bins(m):
    return act.active_users_by_bins(m, P1, EXT_START, D2, P1.days)


# Weekly bins over a range that is not a multiple of 7 (last bin runs past the end), no user lists.
_WB_START, _WB_END = P1.date_from - timedelta(days=10), P1.date_to


@register("active_users_by_bins_unfiltered", "activation", _binned(P1_F0, _WB_START, _WB_END, 7, listed=False), mart="events")
def active_users_by_bins_unfiltered(m):
    return act.active_users_by_bins(m, P1_F0, _WB_START, _WB_END, 7)


def _grid(spec, total_always):
    """Every (day, series) of the range: cities that were seen, and Total; days count who was seen.

    ``total_always``: Total has its line even if nobody was seen in the whole range.
    """
    total = "SELECT 'Total' AS series" + ("" if total_always else " WHERE EXISTS (FROM named)")
    return _on_facts(spec, """
SELECT day, series, count(user_id) AS value FROM grid LEFT JOIN named USING (day, series) GROUP BY day, series""", f"""
in_range AS (SELECT s.user_id, s.day, ifnull(city, 'UNKNOWN') AS city FROM seen s JOIN chosen USING (user_id) WHERE {_within(spec.date_from, spec.date_to, 's.day')}),
named AS (SELECT user_id, day, unnest([city, 'Total']) AS series FROM in_range),
grid AS (SELECT day, series FROM ({days(spec.date_from, spec.date_to)}), (SELECT series FROM named UNION {total}))""")


@register("dau_by_dim", "activation", _grid(P1_F0, total_always=True), mart="events")
def dau_by_dim(m):
    return act.dau_by_dim(m, P1_F0)


@register("dau_by_dim_summed_total", "activation", _grid(P1_F0, total_always=False), mart="events")
def dau_by_dim_summed_total(m):
    return act.dau_by_dim_summed_total(m, P1_F0)


@register("dau_by_dim_empty_range", "activation", _grid(P4, total_always=True), mart="events")
def dau_by_dim_empty_range(m):
    return act.dau_by_dim(m, P4)


_CITIES = f"""
cities AS (SELECT ifnull(city, 'UNKNOWN') AS dim, count(*) AS active_users
           FROM chosen SEMI JOIN (FROM seen WHERE {_in_range(P1_F0)}) USING (user_id) GROUP BY dim)"""


@register("active_users_by_user_dim", "activation", _on_facts(P1_F0, "FROM cities", _CITIES), mart="events")
def active_users_by_user_dim(m):
    return act.active_users_by_user_dim(m, P1_F0, Dim.CITY)


# a user's first order of the range decides; the order lists apply to that order, not to the choice of it
@register("active_users_by_first_order_dim", "activation", _on_facts(P1_CAT, f"""
SELECT ifnull(category, 'Sin compra') AS dim, count(*) AS active_users
FROM (SELECT DISTINCT user_id FROM seen WHERE {_in_range(P1_CAT)}) LEFT JOIN firsts USING (user_id)
  LEFT JOIN mv ON vendor_id = first_order.vendor_id
WHERE true{one_of('category', P1_CAT.categories)}{one_of('first_order.order_status', P1_CAT.statuses)}
GROUP BY dim""", f"""
firsts AS (SELECT user_id, arg_min(o, (o.order_date, o.order_id)) AS first_order FROM mo o
           WHERE {_within(D1, D2, 'o.order_date::DATE')} GROUP BY user_id)"""), mart="events")
def active_users_by_first_order_dim(m):
    return act.active_users_by_first_order_dim(m, P1_CAT, Dim.CATEGORY)


@register("active_users_share_top8", "activation", _on_facts(P1_F0, """
SELECT dim, active_users, round_even(100.0 * active_users / greatest(sum(active_users) OVER (), 1)::DOUBLE, 1) AS share_pct
FROM (FROM cities QUALIFY row_number() OVER (ORDER BY active_users DESC, dim) <= 7)
UNION ALL SELECT 'Total', coalesce(sum(active_users), 0)::BIGINT, 100 FROM cities""", _CITIES), mart="events")
def active_users_share_top8(m):
    return act.active_users_share_top8(m, P1_F0, Dim.CITY)


# the first bin with anyone begins the first period
@register("active_users_period_bars", "activation", f"""
SELECT no AS period_idx, strftime(since, '%m-%d') || '→' || strftime(since + {P1.days - 1}, '%m-%d') AS label,
  value, no = 6 AS selected
FROM (SELECT (day - min(day) OVER ()) // {P1.days} AS no, min(day) OVER () + (no * {P1.days})::INT AS since, value FROM ({_BINS}))""",
          mart="events")
def active_users_period_bars(m):
    return period_bars(act.active_users_by_bins(m, P1, EXT_START, D2, P1.days), P1.days, 6)


# ---- ranges answered from kept day bitmaps ---------------------------------------------------------
_JAN1, _JAN31 = date(2024, 1, 1), date(2024, 1, 31)


# every user under each name and each period that the day belongs to
@register("active_users_bitmaps", "activation", _on_facts(P1_F0, f"""
SELECT grain, period, dim, series, count(DISTINCT user_id) AS active_users
FROM named, LATERAL (SELECT 'day' AS grain, day AS period UNION ALL SELECT 'month', date_trunc('month', day)::DATE
  UNION ALL SELECT 'trailing', day + i::INT FROM range(7) r(i) WHERE day + i::INT >= {d(_JAN1)} + 6 AND day + i::INT <= {d(_JAN31)})
GROUP BY ALL""", f"""
named AS (
  SELECT user_id, day, unnest(['total', 'city', 'channel', 'device']) AS dim,
         unnest(['Total', ifnull(city, 'UNKNOWN'), ifnull(channel, 'UNKNOWN'), ifnull(device, 'UNKNOWN')]) AS series
  FROM seen JOIN chosen USING (user_id) WHERE {_within(_JAN1, _JAN31)})"""), mart="events")
def active_users_bitmaps(m):
    kept = written(bits.day_bitmaps(m, P1_F0, _JAN1, _JAN31))  # what follows reads bitmaps alone
    return bits.active_by_grain(kept, _JAN1, _JAN31)


# ---- irregular and overlapping spans ---------------------------------------------------------------
CAMPAIGNS = (("week one", date(2024, 1, 1), date(2024, 1, 7)), ("kings", date(2024, 1, 6), date(2024, 1, 6)),
             ("winter sale", date(2024, 1, 3), date(2024, 1, 19)), ("mid month", date(2024, 1, 10), date(2024, 1, 16)),
             ("january", date(2024, 1, 1), date(2024, 1, 31)), ("february", date(2024, 2, 1), date(2024, 2, 29)),
             ("everything", date(1990, 1, 1), date(2060, 12, 31)), ("long ago", date(2001, 3, 1), date(2001, 9, 30)))
_SPANS = "spans(span, start_day, end_day) AS (VALUES " + ", ".join(f"('{n}', {d(a)}, {d(b)})" for n, a, b in CAMPAIGNS) + ")"


@register("active_users_by_campaign", "activation", _on_facts(P1, """
SELECT span, start_day, end_day, count(DISTINCT user_id) AS active_users
FROM spans LEFT JOIN seen ON day BETWEEN start_day AND end_day GROUP BY ALL""", _SPANS), mart="events")
def active_users_by_campaign(m):
    return intervals.active_users_in_spans(m, P1, CAMPAIGNS)


@register("spend_by_campaign", "activation", with_mart(EVENTS_MART, _SPANS, """
SELECT span, count(order_id) AS orders, coalesce(sum(order_total), 0)::DOUBLE AS revenue
FROM spans LEFT JOIN mo ON order_date::DATE BETWEEN start_day AND end_day GROUP BY span"""), mart="events")
def spend_by_campaign(m):
    return intervals.spend_in_spans(m, CAMPAIGNS)
