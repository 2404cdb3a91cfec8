"""DuckDB text of the fixture marts and of FilterSpec predicates, for the oracle queries.

Each oracle is written from the definition of the query's output, for DuckDB, over the same Parquet
tables, and independently of the Spark plan: small facts first (who counts, which days they were seen,
what they bought), then one aggregate over a fact. Mart CTEs are mu (users), ms (sessions), mo (orders)
and mv (vendors); ``facts`` derives from them chosen, seen and bought for one FilterSpec.
"""

from __future__ import annotations

from datetime import date

from pulse.functions.filters import FilterSpec

EVENTS_MART = """
mu AS (
  SELECT c_custkey AS user_id,
         CASE WHEN c_custkey % 50 <> 0 THEN c_mktsegment END AS city,
         r_name AS acquisition_channel,
         CASE c_custkey % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END AS device,
         timestamp '2023-12-01 00:00:00' + to_days(cast((c_custkey * 37) % 62 AS int))
           + to_hours(cast(c_custkey % 24 AS int)) AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
mv AS (
  SELECT p_partkey AS vendor_id, p_brand AS city, p_type AS category, cast(p_size AS double) / 10 AS rating
  FROM part),
ms AS (
  SELECT event_id AS session_id, user_id, ts AS session_date
  FROM events WHERE event_type IN ('view', 'click', 'signup')),
mo AS (
  SELECT event_id AS order_id, user_id, CASE WHEN k < 90 THEN (event_id * 31 + k) % (SELECT count(*) FROM part) END AS vendor_id,
         ts AS order_date,
         CASE WHEN event_id % 10 = 0 THEN 'pending'
              WHEN event_type = 'purchase' THEN 'completed' ELSE 'cancelled' END AS order_status,
         cast(value AS decimal(18,2)) AS order_total,
         cast(cast(value AS decimal(18,2)) * cast(0.1 AS decimal(2,1)) AS decimal(18,2)) AS commission
  FROM (SELECT *, cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k FROM events) e
  WHERE event_type IN ('purchase', 'error'))"""

SALES_MART = """
mu AS (
  SELECT c_custkey AS user_id,
         CASE WHEN c_custkey % 50 <> 0 THEN c_mktsegment END AS city,
         r_name AS acquisition_channel,
         CASE c_custkey % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END AS device,
         timestamp '1995-01-01 00:00:00' + to_days(cast((c_custkey * 37) % 2400 AS int)) AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
mv AS (
  SELECT s_suppkey AS vendor_id, n_name AS city, r_name AS category,
         cast(10 + s_suppkey % 41 AS double) / 10 AS rating
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
mo AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, l.vendor_id AS vendor_id, o_orderdate AS order_date,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'cancelled' ELSE 'pending' END AS order_status,
         cast(o_totalprice AS decimal(18,2)) AS order_total,
         cast(cast(o_totalprice AS decimal(18,2)) * cast(0.1 AS decimal(2,1)) AS decimal(18,2)) AS commission
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS vendor_id FROM lineitem GROUP BY l_orderkey) l
    ON l_orderkey = o_orderkey),
ms AS (SELECT user_id, created_at AS session_date FROM mu WHERE false)"""


def d(x: date) -> str:
    return f"DATE '{x.isoformat()}'"


def one_of(column: str, values) -> str:
    """A test for membership in a parameter list; an empty list tests nothing."""
    return f" AND list_contains({list(values)!r}, {column})" if values else ""


def days(a: date, b: date, name: str = "day") -> str:
    """SELECT of every day from a to b."""
    return f"SELECT {d(a)} + i::INT AS {name} FROM range({(b - a).days + 1}) AS r(i)"


def facts(spec: FilterSpec, vendors: str = "JOIN", statuses: bool = True) -> str:
    """CTEs for a FilterSpec: chosen users, the days each was seen, and what they bought in the range.

    ``vendors``: JOIN keeps orders with a vendor, LEFT JOIN all (a category list then asks for a vendor
    anyway). ``seen`` has every (user, day); ``bought`` is limited to the range and the lists.
    """
    return f"""
chosen AS (
  SELECT user_id, city, acquisition_channel AS channel, device, created_at::DATE AS joined, created_at
  FROM mu WHERE true{one_of('city', spec.cities)}{one_of('acquisition_channel', spec.channels)}{one_of('device', spec.devices)}),
seen AS (SELECT user_id, session_date::DATE AS day FROM ms SEMI JOIN chosen USING (user_id) GROUP BY ALL),
bought AS (
  SELECT o.order_id, o.user_id, o.order_date::DATE AS day, o.order_status AS status, o.vendor_id,
         CASE o.order_status WHEN 'completed' THEN o.order_total END AS paid,
         CASE o.order_status WHEN 'completed' THEN o.commission END AS fee,
         c.city, c.channel, c.device, v.category, v.city AS vendor_city, v.rating
  FROM chosen c JOIN mo o USING (user_id) {vendors} mv v USING (vendor_id)
  WHERE day >= {d(spec.date_from)} AND day <= {d(spec.date_to)}{one_of('v.category', spec.categories)}{one_of('status', spec.statuses) if statuses else ''})"""


#: Columns of an aggregate over ``bought``.
N_ALL = "count(*) AS orders_total"
N_DONE = "count(paid) AS orders_completed"
N_GONE = "count(*) FILTER (status = 'cancelled') AS orders_cancelled"
GMV = "coalesce(sum(paid), 0)::DOUBLE AS gmv"
FEES = "coalesce(sum(fee), 0)::DOUBLE AS commission"


def part_of(n: str, whole: str) -> str:
    """n / whole as double, 0 where whole is not positive."""
    return f"if({whole} > 0, ({n})::DOUBLE / ({whole}), 0::DOUBLE)"


def with_mart(mart: str, body_ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(x.strip() for x in (mart, body_ctes) if x.strip()) + "\n" + select.strip()
