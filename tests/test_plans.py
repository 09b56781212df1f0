"""Plan-shape checks: the scale properties the README claims, asserted on
``explain`` output (pruning, join elimination, partial limits / aggregates)."""

import io
import re
import contextlib

import pytest
from pyspark.sql import functions as F

from tidecast.operators import aggregate as agg
from tidecast.operators import items as it
from tidecast.plans import load_all
from tidecast.sources.tables import items_from_events, monthly_word_counts, order_facts

from .conftest import SF_SMALL

QUERIES = load_all()[0]


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_unused_dimension_joins_are_eliminated(spark):
    p = plan(agg.aggregate_periods(order_facts(spark, SF_SMALL, category=False, segment=False), "monthly"))
    assert "part.parquet" not in p and "customer.parquet" not in p
    assert "lineitem.parquet" in p and "orders.parquet" in p
    only_orders = plan(order_facts(spark, SF_SMALL, category=False, segment=False).groupBy("payment_method").count())
    assert "lineitem.parquet" not in only_orders


def test_scan_reads_only_needed_columns(spark):
    p = plan(agg.aggregate_periods(order_facts(spark, SF_SMALL), "monthly"))
    orders_schema = [ln for ln in p.splitlines() if "ReadSchema" in ln and "o_orderkey" in ln][0]
    assert "o_orderpriority" not in orders_schema and "o_orderstatus" not in orders_schema
    assert "PushedFilters: [IsNotNull(o_orderdate)]" in p


def test_period_partials_scan_each_branch_once(spark):
    p = plan(agg.period_partials(order_facts(spark, SF_SMALL), "monthly", agg.PIVOTS))
    scans = [ln for ln in p.splitlines() if re.match(r"^\(\d+\) Scan parquet", ln)]
    # lineitem (measures), lineitem (order -> part pairs), part, orders, customer: once each
    assert len(scans) == 5
    assert "partial_count" in p                  # map-side partial aggregation before the shuffle


def test_top_n_limits_before_the_shuffle(spark):
    p = plan(it.top_per_month(items_from_events(spark, SF_SMALL), 10))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_dedupe_is_partially_aggregated(spark):
    p = plan(it.dedupe_first(items_from_events(spark, SF_SMALL).drop("upload_ts")))
    assert "partial_min_by" in p


def test_word_counts_preaggregate_before_part_join(spark):
    p = plan(monthly_word_counts(spark, SF_SMALL))
    # the (month, partkey) aggregate is complete before the part join's keys appear
    agg_at = re.search(r"Keys \[2\]: \[m#\d+L?, l_partkey#\d+L?\]", p).start()
    join_at = re.search(r"Right keys \[1\]: \[p_partkey#\d+L?\]", p).start()
    assert agg_at < join_at


def test_hot_key_dedupe_and_top_n_are_exact(spark):
    # one URL holds a third of all rows: results stay whole and exact
    n = 3000
    rows = [(("hot" if i % 3 == 0 else f"u{i}"), i, i % 7, "k") for i in range(n)]
    df = spark.createDataFrame(rows, "url string, seq_no long, view_count long, keyword string")
    d = {r["url"]: r["seq_no"] for r in it.dedupe_first(df).collect()}
    assert d["hot"] == 0 and len(d) == 1 + (n - n // 3)
    top = it.top_n(df, ["keyword"], 5, [F.desc("view_count"), F.asc("seq_no")]).collect()
    assert [r["seq_no"] for r in sorted(top, key=lambda r: r["rank"])] == [6, 13, 20, 27, 34]


def test_results_do_not_depend_on_aqe_or_partition_count(spark):
    import __spark_entry__ as entry
    from tools.oracle_check import rows_of
    q = entry.queries()
    names = ["vocabulary", "full_dataset_monthly", "items_top_n_month", "word_correlation_scores"]
    base = {n: rows_of(q[n](spark, SF_SMALL).toPandas()) for n in names}
    prev = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for n in names:
            assert rows_of(q[n](spark, SF_SMALL).toPandas()) == base[n], n
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)


def test_hot_part_and_customer_are_split(spark, tmpdir_path):
    """A third of all rows on one part and one customer, broadcasts off: AQE splits both joins, results agree."""
    import os
    for name in ("orders", "lineitem", "part", "customer"):
        t = spark.read.parquet(os.path.join("/root/testdata/sf0.01", f"{name}.parquet"))
        if name == "orders":
            t = t.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey")))
        if name == "lineitem":
            t = t.withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_partkey")))
        t.repartition(8).write.parquet(os.path.join(tmpdir_path, f"{name}.parquet"))
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100b",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100b",
           "spark.sql.adaptive.coalescePartitions.enabled": "false",
           "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}   # one scan task per file
    want = {}
    for setting in ({}, low):
        old = {k: spark.conf.get(k, None) for k in setting}
        for k, v in setting.items():
            spark.conf.set(k, v)
        try:
            for name, flags in (("category", {"segment": False}), ("customer_segment", {"category": False})):
                df = order_facts(spark, tmpdir_path, **flags).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
                got = {tuple(r) for r in df.collect()}
                assert want.setdefault(name, got) == got
                if setting:
                    assert "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString(), name
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


ONE_SCAN = {"standard_scale": "orders", "standard_scale_sequences": "orders", "minmax_scale_roundtrip": "orders",
            "residual_summary": "orders", "collection_coverage": "events"}


@pytest.mark.parametrize("name", sorted(ONE_SCAN))
def test_scaled_queries_scan_their_facts_once(spark, monkeypatch, name):
    """Statistics and what they are applied to come from one written table; no row count or bound passes the driver."""
    from tidecast.operators import items
    from tidecast.plans import queries_series
    written = []

    def noted(df, label, write=queries_series.materialise):
        written.append(plan(df))
        return write(df, label)

    def refused(self, *a, **k):
        raise AssertionError("a driver round trip")

    monkeypatch.setattr(queries_series, "materialise", noted)
    monkeypatch.setattr(items, "materialise", noted)
    for action in ("first", "collect", "count", "head", "toPandas"):
        monkeypatch.setattr(type(spark.range(1)), action, refused)
    final = plan(QUERIES[name](spark, SF_SMALL))
    scans = [p.count(f"/{ONE_SCAN[name]}.parquet") for p in (*written, final)]
    assert scans == [1, 0]
