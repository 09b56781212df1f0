"""Windows over long series: blocks with copied rows equal one window over the whole series."""

import pytest
from pyspark.sql import functions as F

from tidecast.operators import long_series as ls
from tidecast.operators import timeseries as ts

LAGS, WINDOWS = [1, 3, 12], [2, 5]


def series(spark, rows):
    return spark.createDataFrame(rows, "key string, at long, x double, extra string")


def made(spark, n=400):
    rows = [("hot", i, float((i * 37) % 101) - 20, "e") for i in range(n)]
    rows += [("short", i, float(i), None) for i in range(5)]
    rows += [(None, i, None if i % 7 == 0 else float(i % 9), "e") for i in range(60)]
    return series(spark, rows)


def plain(df, keys):
    out = ts.add_rolling(ts.add_lags(df, "x", LAGS, order_col="at", series_keys=keys), "x", WINDOWS, order_col="at", series_keys=keys)
    return ts.add_growth(ts.trailing_stats(out, "x", 4, order_col="at", series_keys=keys), "x", order_col="at", series_keys=keys)


def rounded(df):
    return sorted([tuple("" if v is None else round(v, 6) if isinstance(v, float) else v for v in r)
                   for r in df.select(sorted(df.columns)).collect()], key=str)


@pytest.mark.parametrize("rows_per_block", [1, 13, 50, 10_000])
def test_blocks_equal_whole_windows(spark, rows_per_block):
    df = made(spark)
    got = ls.add_time_series_features(df, "x", LAGS, WINDOWS, trailing=4, order_col="at", series_keys=["key"], rows_per_block=rows_per_block)
    assert rounded(got) == rounded(plain(df, ["key"]))


def test_without_keys_and_empty(spark):
    df = made(spark).where("key = 'hot'")
    got = ls.add_time_series_features(df, "x", LAGS, WINDOWS, trailing=4, order_col="at", rows_per_block=20)
    assert rounded(got) == rounded(plain(df, []))
    none = ls.add_time_series_features(df.limit(0), "x", LAGS, WINDOWS, order_col="at", series_keys=["key"])
    assert none.count() == 0 and "x_lag_12" in none.columns


def test_split_equals_plain(spark):
    df = made(spark)
    got = ls.chrono_split(df, 0.2, order_col="at", series_keys=["key"])
    assert rounded(got) == rounded(ts.chrono_split(df, 0.2, order_col="at", series_keys=["key"]))


def test_ties_follow_tie_cols(spark):
    df = series(spark, [("k", i // 3, float(i), str(i % 3)) for i in range(90)])
    got = ls.in_blocks(df, 2, lambda d, order, keys: ts.add_lags(d, "x", [1, 2], order_col=order, series_keys=keys),
                       order_col="at", series_keys=["key"], tie_cols=["extra"], rows_per_block=7)
    assert {(r["x"], r["x_lag_1"], r["x_lag_2"]) for r in got.collect()} == {
        (float(i), float(i - 1) if i else None, float(i - 2) if i > 1 else None) for i in range(90)}


def test_one_hot_key_uses_many_tasks(spark):
    """One key of ten million rows: no partition of the windows holds more than a few blocks of it."""
    df = spark.range(10_000_000).select(F.lit("hot").alias("key"), F.col("id").alias("at"), (F.col("id") % 97).cast("double").alias("x"))

    def lags(rows, order, keys):
        out = ts.add_lags(rows, "x", [1, 12], order_col=order, series_keys=keys)
        return out.withColumn("task", F.spark_partition_id())

    got = ls.in_blocks(df, 12, lags, order_col="at", series_keys=["key"], rows_per_block=100_000)
    wrong = (F.col("at") >= 12) & ((F.col("x_lag_12") != (F.col("at") - 12) % 97) | F.col("x_lag_12").isNull())
    row = got.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"), F.count_distinct("task").alias("tasks")).first()
    assert (row["n"], row["wrong"]) == (10_000_000, 0)
    assert row["tasks"] > 1
