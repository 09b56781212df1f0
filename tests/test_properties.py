"""Edge cases and invariants on small hand-made order facts (FIXTURES F-1)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecast.operators import aggregate as agg
from tidecast.operators import items as it
from tidecast.operators import scaling as sc
from tidecast.operators import timeseries as ts
from tidecast.sources.tables import order_facts

from .conftest import SF_SMALL

SCHEMA = ("order_id string, order_date timestamp_ntz, order_total double, quantity double, "
          "customer_id_x string, delivery_time_minutes double, rating double, category string, "
          "customer_segment string, delivery_status_x string, sentiment string, payment_method string")


def _ts(s):
    return dt.datetime.fromisoformat(s)


ROWS = [
    ("1", _ts("2024-01-07 10:00:00"), 100.0, 1.0, "c1", 5.0, 4.0, "Baby Care", "New", "On Time", "Positive", "UPI"),
    ("2", _ts("2024-01-08 09:00:00"), 50.0, 2.0, "c2", 7.0, 3.0, None, "Regular", "Slightly Delayed", "Negative", "Card"),
    ("3", _ts("2024-01-20 00:00:00"), 25.0, None, "c1", None, None, "Pet Care", "New", "On Time", "Neutral", "Cash"),
    ("4", _ts("2024-02-10 00:00:00"), 80.0, 1.0, "c3", 10.0, 5.0, "Pet Care", "Premium", "Significantly Delayed",
     "Positive", "Wallet"),
    ("5", _ts("2024-04-03 00:00:00"), 0.0, 1.0, "c1", 3.0, 2.0, "Baby Care", "New", "On Time", "Negative", "UPI"),
    ("6", _ts("2024-05-05 00:00:00"), 30.0, 3.0, "c2", 4.0, 4.0, "Baby Care", "Inactive", "On Time", "Positive", "UPI"),
]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _by_period(df):
    return {r["period"]: r for r in df.collect()}


def test_monthly_aggregates_and_gaps(facts):
    m = _by_period(agg.aggregate_periods(facts, "monthly"))
    assert sorted(m) == ["2024-01", "2024-02", "2024-04", "2024-05"]      # gap not filled
    jan, feb = m["2024-01"], m["2024-02"]
    assert jan["order_count"] == 3 and jan["total_sales"] == 175.0
    assert jan["unique_customers"] == 2
    assert jan["total_quantity"] == 3.0                                    # NULL skipped
    assert feb["std_order_value"] == 0.0 and feb["std_delivery_time"] == 0.0  # one order -> 0
    assert jan["day_of_week"] == 0 and jan["month"] == 1                  # 2024-01-01 is a Monday


def test_week_break_sunday_monday(facts):
    w = _by_period(agg.aggregate_periods(facts, "weekly"))
    assert w[dt.date(2024, 1, 1)]["order_count"] == 1     # Sunday 7th -> week of Monday 1st
    assert w[dt.date(2024, 1, 8)]["order_count"] == 1     # Monday 8th starts a new week


def test_pivots_ignore_null_keys_and_rename(facts):
    full = agg.full_dataset(facts, "monthly")
    cols = full.columns
    assert "delivery_On_Time" in cols and "delivery_Slightly_Delayed" in cols
    assert "cat_sales_Baby Care" in cols
    jan = _by_period(full)["2024-01"]
    assert jan["cat_sales_Baby Care"] + jan["cat_sales_Pet Care"] == 125.0   # NULL category dropped
    seg = sum(v for k, v in jan.asDict().items() if k.startswith("seg_sales_"))
    pay = sum(v for k, v in jan.asDict().items() if k.startswith("payment_"))
    deliv = sum(v for k, v in jan.asDict().items() if k.startswith("delivery_"))
    sent = sum(v for k, v in jan.asDict().items() if k.startswith("sentiment_"))
    assert seg == pay == jan["total_sales"]
    assert deliv == sent == jan["order_count"]
    assert isinstance(jan["delivery_On_Time"], float)


def test_growth_guards_and_positional_lags(facts):
    p = agg.aggregate_periods(facts, "monthly").select("period", "total_sales")
    out = _by_period(ts.add_time_series_features(p, "total_sales", [1, 2], [2]))
    assert out["2024-04"]["total_sales_lag_1"] == 80.0        # previous ROW (February)
    assert out["2024-05"]["total_sales_mom_growth"] == 0.0    # previous value 0 -> inf -> 0
    assert out["2024-04"]["total_sales_mom_growth"] == pytest.approx(-1.0)
    assert all(r["total_sales_yoy_growth"] == 0.0 for r in out.values())   # < 13 rows
    assert out["2024-01"]["total_sales_ma_2"] == 0.0          # NULL until full, then filled


def test_identities_on_driver_tables(spark):
    full = agg.full_dataset(order_facts(spark, SF_SMALL), "monthly").toPandas()
    pay = full[[c for c in full.columns if c.startswith("payment_")]].sum(axis=1)
    deliv = full[[c for c in full.columns if c.startswith("delivery_")]].sum(axis=1)
    seg = full[[c for c in full.columns if c.startswith("seg_sales_")]].sum(axis=1)
    assert (abs(pay - full["total_sales"]) <= 1e-6 * full["total_sales"].abs().clip(lower=1)).all()
    assert (abs(seg - full["total_sales"]) <= 1e-6 * full["total_sales"].abs().clip(lower=1)).all()
    assert (deliv == full["order_count"]).all()


def test_scaling_conventions(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    st = sc.fit_standard(df, ["x", "c"])
    assert st.std["c"] == 0.0
    z = df.select(sc.standard_expr("c", "c", st).alias("z")).collect()
    assert all(r["z"] == 0.0 for r in z)                         # sigma 0 -> divide by 1
    mm = sc.fit_minmax(df, ["x", "c"])
    rows = df.select(sc.minmax_expr("x", "x", mm).alias("s"), sc.minmax_expr("c", "c", mm).alias("k"),
                     sc.inverse_minmax_expr(sc.minmax_expr("x", "x", mm), "x", mm).alias("r"), "x").collect()
    assert [r["s"] for r in rows] == [0.0, 1 / 3, 1.0]
    assert all(r["k"] == 0.0 for r in rows)                      # constant -> 0 (not 0.5)
    assert all(abs(r["r"] - r["x"]) < 1e-12 for r in rows)
    with pytest.raises(ValueError):
        sc.inverse_minmax_expr("x", "x", None)


def test_dedupe_idempotent_and_keeps_first(spark):
    items = spark.createDataFrame(
        [("a", 3, "t3"), ("a", 1, "t1"), ("b", 2, "t2"), ("a", 5, "t5")], "url string, seq_no long, title string")
    once = it.dedupe_first(items)
    twice = it.dedupe_first(once)
    got = {r["url"]: r["title"] for r in once.collect()}
    assert got == {"a": "t1", "b": "t2"}
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_iso_date_never_raises(spark):
    df = spark.createDataFrame([("20240131",), ("20241399",), ("",), (None,), ("2024",)], "d string")
    got = [r[0] for r in df.select(it.iso_upload_date(F.col("d"))).collect()]
    assert got == ["2024-01-31T00:00:00", "", "", "", ""]


def test_chrono_split_counts(spark):
    df = spark.range(80).withColumnRenamed("id", "period")
    s = ts.chrono_split(df, 0.2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 64, "validation": 16}


def test_weighted_statistics_equal_pooled_windows(spark):
    """A row weighted by the training windows that hold it = statistics over the exploded windows."""
    from tidecast.operators import sequences as sq
    from tidecast.operators import timeseries as ts
    for n, length in ((40, 6), (7, 6), (6, 6), (3, 6), (25, 1)):
        df = spark.createDataFrame([(i, float((i * i) % 17), 5.0) for i in range(n)], "period long, x double, c double")
        weighted = sc.window_weights(df, length, 0.2)
        row = sc.standard_stats(weighted, ["x", "c"], weight="weight").first()
        seq = ts.chrono_split(sq.build_sequences(df, ["x", "c"], "x", length), 0.2).where("split = 'train'")
        pooled = sc.standard_stats(seq.select(F.explode("x_seq").alias("v")).select(F.col("v")[0].alias("x"), F.col("v")[1].alias("c")), ["x", "c"]).first()
        assert row.asDict() == pytest.approx(pooled.asDict(), abs=1e-9)
        assert row["_s_c"] == 1.0


def test_scaled_frames_of_awkward_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (3, None, 4.0)], "id long, `a.b` double, y double")
    z = {r["id"]: r for r in sc.standard_scaled(df, sc.standard_stats(df, ["a.b", "y"]), ["a.b", "y"]).collect()}
    assert [z[i]["y_z"] for i in (1, 2, 3)] == [-1.0, None, 1.0] and z[1]["a.b_z"] is None
    s = sc.minmax_scaled(df, sc.minmax_stats(df, ["y"]), ["y"])
    assert [r["back"] for r in s.select(sc.minmax_restored(F.col("y_scaled"), "y").alias("back")).collect()] == [2.0, None, 4.0]
    none = df.limit(0)
    assert sc.standard_scaled(none, sc.standard_stats(none, ["y"]), ["y"]).count() == 0
