"""Streaming refresh over order files equals the batch daily series."""

from pulse.functions.filters import FilterSpec
from pulse.operators import sales
from pulse.sources.marts import Marts, events_mart
from pulse.streaming.refresh import daily_sales_stream, order_stream, start_refresh

from conftest import SF_SMALL
from datetime import date


def test_stream_matches_batch(spark, scratch):
    m = events_mart(spark, SF_SMALL).live()
    src = scratch + "/orders"
    m.orders.repartition(3).write.parquet(src)
    q = start_refresh(daily_sales_stream(order_stream(spark, src, 1), m.users, m.vendors, lateness="3650 days"),
                      scratch + "/ckpt", query_name="pulse_daily", output_mode="complete")
    q.awaitTermination()
    got = {r["day"]: (r["orders_total"], r["gmv"]) for r in spark.table("pulse_daily").collect()}
    batch = sales.sales_timeseries(Marts(m.users, m.sessions, m.orders, m.vendors),
                                   FilterSpec(date(2024, 1, 1), date(2024, 1, 31)))
    want = {r["day"]: (r["orders_total"], r["gmv"]) for r in batch.collect()}
    assert got == want
