"""Registered acquisition queries (events mart) and their oracle SQL."""

from __future__ import annotations

from datetime import timedelta

from pulse.operators import acquisition as acq
from pulse.plans.catalog import register
from pulse.plans.params import P1, P1_CAT, P1_F2, P4
from pulse.plans.sqltext import EVENTS_MART, d, days, facts, part_of, with_mart

D1, D2 = P1.date_from, P1.date_to
EXT_START = D1 - timedelta(days=P1.days * 6)


def _on_facts(spec, select, more=""):
    return with_mart(EVENTS_MART, facts(spec) + ("," + more if more else ""), select)


def _joined(a, b):
    return f"joined >= {d(a)} AND joined <= {d(b)}"


@register("users_base_vs_new", "acquisition", _on_facts(P1, f"""
SELECT count_if(joined < {d(D1)})::BIGINT AS base_before, count_if({_joined(D1, D2)})::BIGINT AS new_in_range, count(*) AS total_all
FROM chosen"""), mart="events")
def users_base_vs_new(m):
    return acq.users_base_vs_new(m, P1)


_PD1, _PD2 = P1.previous_window()


@register("new_users_vs_prev", "acquisition", _on_facts(P1, f"""
SELECT users_before, new_users, new_users_prev, users_before + new_users AS total_considered,
  {part_of('new_users', 'users_before + new_users')} AS pct_new, {d(_PD1)} AS prev_d1, {d(_PD2)} AS prev_d2,
  new_users - new_users_prev AS delta_abs,
  CASE new_users_prev WHEN 0 THEN least(new_users, 1)::DOUBLE ELSE (new_users - new_users_prev)::DOUBLE / new_users_prev END AS delta_pct,
  new_users::DOUBLE / {P1.days} AS avg_new_per_day
FROM (SELECT count_if(joined < {d(D1)})::BIGINT AS users_before, count_if({_joined(D1, D2)})::BIGINT AS new_users,
        count_if({_joined(_PD1, _PD2)})::BIGINT AS new_users_prev FROM chosen)"""), mart="events")
def new_users_vs_prev(m):
    return acq.new_users_vs_prev(m, P1)


def _daily(a, b):
    """Every day with the number of users who joined on it."""
    return f"""
daily AS (SELECT day, count(user_id) AS new_users FROM ({days(a, b)}) LEFT JOIN chosen ON joined = day GROUP BY day)"""


@register("new_users_daily", "acquisition", _on_facts(P1, "FROM daily", _daily(D1, D2)), mart="events")
def new_users_daily(m):
    return acq.new_users_daily(m, P1)


@register("new_users_daily_empty_range", "acquisition", _on_facts(P4, "FROM daily", _daily(P4.date_from, P4.date_to)),
          mart="events")
def new_users_daily_empty_range(m):
    return acq.new_users_daily(m, P4)


@register("new_users_daily_extended", "acquisition", _on_facts(P1, "FROM daily", _daily(EXT_START, D2)), mart="events")
def new_users_daily_extended(m):
    return acq.new_users_daily_extended(m, P1, EXT_START, D2)


# the running total of a day is everyone who had joined by its end
@register("new_users_cumulative", "acquisition", _on_facts(P1, """
SELECT day, new_users, (SELECT count(*) FROM chosen WHERE joined <= day) AS users_cum FROM daily""", _daily(D1, D2)),
          mart="events")
def new_users_cumulative(m):
    return acq.new_users_cumulative(m, P1)


@register("new_users_delta", "acquisition", _on_facts(P1, """
SELECT day, t.new_users, t.new_users - ifnull(y.new_users, 0) AS delta_new
FROM daily t LEFT JOIN (SELECT day + 1 AS day, new_users FROM daily) y USING (day)""", _daily(D1, D2)), mart="events")
def new_users_delta(m):
    return acq.new_users_delta(m, P1)


def _by_city(spec, total_of, running=False):
    """Signups by (day, selected city) and in total: of the selected cities, or of all chosen users."""
    cities = list(spec.cities)
    dense = f"""
arrivals AS (SELECT joined AS day, unnest(list_concat(list_intersect([city], {cities!r}), ['Total'])) AS series FROM chosen
             WHERE {_joined(D1, D2)}{f" AND list_contains({cities!r}, city)" if total_of == "selected" else ''}),
dense AS (SELECT day, series, count(a.series) AS value
          FROM ({days(D1, D2)}) CROSS JOIN (SELECT unnest({cities + ['Total']!r}) AS series) LEFT JOIN arrivals a USING (day, series) GROUP BY ALL)"""
    if not running:
        return _on_facts(spec, "SELECT day, series, value FROM dense", dense)
    return _on_facts(spec, """
SELECT t.day, t.series, any_value(t.value) AS value, sum(e.value)::BIGINT AS cum_in_range
FROM dense t JOIN dense e ON e.series = t.series AND e.day <= t.day GROUP BY t.day, t.series""", dense)


@register("new_users_by_dim_selected_total", "acquisition", _by_city(P1_F2, "selected"), mart="events")
def new_users_by_dim_selected_total(m):
    return acq.new_users_by_dim_selected_total(m, P1_F2)


@register("new_users_by_dim_true_total", "acquisition", _by_city(P1_F2, "all"), mart="events")
def new_users_by_dim_true_total(m):
    return acq.new_users_by_dim_true_total(m, P1_F2)


# signups by the category of their first order in the range; whoever has none still counts in Total
@register("new_users_by_first_order_dim", "acquisition", _on_facts(P1_CAT, f"""
SELECT day, series, count(e.user_id) AS value
FROM ({days(D1, D2)}) CROSS JOIN (SELECT unnest({[*P1_CAT.categories, 'Total']!r}) AS series) LEFT JOIN entries e USING (day, series)
GROUP BY day, series""", f"""
firsts AS (SELECT user_id, arg_min_null(o.vendor_id, (o.order_date, o.order_id)) AS vendor_id
           FROM mo o WHERE o.order_date >= {d(D1)} AND o.order_date < {d(D2 + timedelta(days=1))} GROUP BY user_id),
entries AS (SELECT c.user_id, c.joined AS day, unnest(['Total', v.category]) AS series
            FROM chosen c LEFT JOIN firsts f USING (user_id) LEFT JOIN mv v ON v.vendor_id = f.vendor_id
            WHERE {_joined(D1, D2)})"""), mart="events")
def new_users_by_first_order_dim(m):
    return acq.new_users_by_first_order_dim(m, P1_CAT)


@register("new_users_cum_by_series", "acquisition", _by_city(P1_F2, "selected", running=True), mart="events")
def new_users_cum_by_series(m):
    return acq.new_users_cum_by_series(m, P1_F2)


_CITIES = f"""
cities AS (SELECT city AS series, count(*) AS n, {part_of('count(*)', '(sum(count(*)) OVER ())::DOUBLE')} AS share,
             row_number() OVER (ORDER BY count(*) DESC, city NULLS LAST) AS place,
             list(user_id::VARCHAR ORDER BY created_at, user_id) AS members
           FROM chosen WHERE {_joined(D1, D2)} GROUP BY city)"""


@register("new_users_share", "acquisition", _on_facts(P1, "SELECT series, n AS new_users, share FROM cities", _CITIES), mart="events")
def new_users_share(m):
    return acq.new_users_share(m, P1)


@register("new_users_samples", "acquisition", _on_facts(P1, """
SELECT series, array_to_string(members[1:5], ', ') AS sample_users FROM cities WHERE place <= 5 AND series IS NOT NULL""", _CITIES),
          mart="events")
def new_users_samples(m):
    return acq.new_users_samples(m, P1)


@register("new_users_top10", "acquisition", _on_facts(P1, "SELECT series AS dim, n AS total_usuarios FROM cities WHERE place <= 10", _CITIES),
          mart="events")
def new_users_top10(m):
    return acq.new_users_top10(m, P1)


@register("new_users_share_summary", "acquisition", _on_facts(P1, """
SELECT series, round_even(share * 100, 1) AS share_pct, n AS total_usuarios FROM cities""", _CITIES), mart="events")
def new_users_share_summary(m):
    return acq.new_users_share_summary(m, P1)


# whole periods of days counted from the first day shown
@register("new_users_period_bins", "acquisition", _on_facts(P1, f"""
SELECT no AS period_idx, strftime(min(day), '%m-%d') || '→' || strftime(min(day) + {P1.days - 1}, '%m-%d') AS label,
  sum(new_users)::BIGINT AS value, no = 6 AS selected
FROM (SELECT *, (day - {d(EXT_START)}) // {P1.days} AS no FROM daily) GROUP BY no""", _daily(EXT_START, D2)), mart="events")
def new_users_period_bins(m):
    return acq.new_users_period_bins(m, P1)
