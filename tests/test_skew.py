"""Hot keys: one user holds a third of sessions and orders, one vendor a third of orders.

Broadcast joins are disabled and AQE skew thresholds lowered so that sort-merge joins
with skew splitting and partial aggregation carry the load; results must equal a
pandas computation.
"""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pandas as pd
import pytest

from pulse.functions.filters import FilterSpec
from pulse.operators import activation as act
from pulse.operators.acquisition import first_order_tags
from pulse.operators import sales
from pulse.sources.marts import Marts

D1, D2 = date(2024, 5, 1), date(2024, 5, 7)


@pytest.fixture()
def skewed_conf(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_user_and_vendor(spark, skewed_conf):
    n_users = 300
    users = pd.DataFrame({"user_id": range(n_users), "city": ["X" if i % 2 else "Y" for i in range(n_users)],
                          "acquisition_channel": "C", "device": "ios",
                          "created_at": [datetime(2024, 4, 1) + timedelta(hours=i) for i in range(n_users)]})
    sess = []
    for i in range(6000):
        u = 0 if i % 3 == 0 else 1 + (i * 7919) % (n_users - 1)
        sess.append((u, datetime(2024, 5, 1) + timedelta(minutes=37 * i % (7 * 24 * 60))))
    sessions = pd.DataFrame(sess, columns=["user_id", "session_date"])
    orders = []
    for i in range(3000):
        u = 0 if i % 3 == 0 else 1 + (i * 104729) % (n_users - 1)
        v = 0 if i % 3 == 1 else 1 + i % 20
        st = ["completed", "cancelled", "pending"][i % 5 % 3]
        orders.append((i, u, v, datetime(2024, 5, 1) + timedelta(minutes=53 * i % (7 * 24 * 60)), st,
                       Decimal(i % 97) + Decimal("0.25"), Decimal(i % 97) / 10))
    orders = pd.DataFrame(orders, columns=["order_id", "user_id", "vendor_id", "order_date", "order_status",
                                           "order_total", "commission"])
    vendors = pd.DataFrame({"vendor_id": range(21), "city": "K", "category": ["A" if v % 2 else "B" for v in range(21)],
                            "rating": 4.0})
    m = Marts(
        spark.createDataFrame(users, "user_id long, city string, acquisition_channel string, device string, created_at timestamp_ntz"),
        spark.createDataFrame(sessions, "user_id long, session_date timestamp_ntz"),
        spark.createDataFrame(orders, "order_id long, user_id long, vendor_id long, order_date timestamp_ntz, "
                                      "order_status string, order_total decimal(18,2), commission decimal(18,2)"),
        spark.createDataFrame(vendors, "vendor_id long, city string, category string, rating double"))
    spec = FilterSpec(D1, D2, cities=("X", "Y"))

    want_dau = sessions.assign(day=sessions.session_date.dt.date).groupby("day").user_id.nunique().to_dict()
    got_dau = {r["day"]: r["dau"] for r in act.dau_daily(m, spec).collect()}
    assert got_dau == want_dau

    got = sales.orders_kpis(m, spec).first()
    assert got["orders_total"] == 3000
    assert got["orders_completed"] == int((orders.order_status == "completed").sum())
    assert got["gmv"] == float(orders.loc[orders.order_status == "completed", "order_total"].sum())

    top = sales.top_vendors_gmv(m, spec, 3).collect()
    comp = orders[orders.order_status == "completed"].groupby("vendor_id").order_total.sum()
    assert top[0]["vendor_id"] == int(comp.idxmax()) and top[0]["gmv"] == float(comp.max())

    first = orders.sort_values(["order_date", "order_id"]).groupby("user_id").first()
    tags = {r["user_id"]: r["fo_status"] for r in first_order_tags(m, spec).collect()}
    assert tags == first.order_status.to_dict()
