"""Registered streaming query (ST1), checked against its batch equivalent."""

from __future__ import annotations

from ..session import scratch_path
from ..sources.tables import table
from ..streaming.period_stream import monthly_rollup, run_available
from .registry import comparable, register


def _stream(freq):
    def q(spark, sf_dir):
        schema = table(spark, sf_dir, "events").schema
        out = run_available(spark, sf_dir, "events.parquet", schema, "ts", ["event_type"], "value", freq)
        return comparable(out)
    return q


register("stream_daily_agg", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period, event_type, count(*) AS n_events,
       CAST(sum(value) AS FLOAT) AS total_value
FROM events GROUP BY 1, 2""")(_stream("daily"))

register("stream_weekly_agg", """
SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS period, event_type, count(*) AS n_events,
       CAST(sum(value) AS FLOAT) AS total_value
FROM events GROUP BY 1, 2""")(_stream("weekly"))


@register("stream_orders_monthly", """
SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n_events, CAST(sum(o_totalprice) AS FLOAT) AS total_value
FROM orders GROUP BY 1""")
def stream_orders_monthly(spark, sf_dir):
    """ST1 on arriving order files: daily partials in the stream, exact monthly roll-up in batch."""
    schema = table(spark, sf_dir, "orders").schema
    daily = run_available(spark, sf_dir, "orders.parquet", schema, "o_orderdate", [], "o_totalprice",
                          "daily", files_per_batch=1)
    return comparable(monthly_rollup(daily))


@register("stream_compacted_distinct", """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period, count(*) AS n_events, CAST(sum(o_totalprice) AS FLOAT) AS total_value,
       count(DISTINCT o_custkey) AS n_distinct
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def stream_compacted_distinct(spark, sf_dir):
    """ST1: orders arriving as many files, one a batch, partials compacted on the way; exact distinct customers a day."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate is not null")
    source = scratch_path(spark, "arriving-orders")
    orders.repartition(12, "o_orderkey").write.parquet(source)
    return comparable(run_available(spark, source, "*.parquet", orders.schema, "o_orderdate", [], "o_totalprice", "daily",
                                    files_per_batch=1, exact_distinct="o_custkey", compact_every=5))
