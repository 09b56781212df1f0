"""Golden replay: the reference's processed monthly table recomputed from its
own ``total_sales`` column (lags, rolling statistics, growth, calendar)."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.functions.calendar import calendar_columns
from tidecast.operators import timeseries as ts

from .conftest import FIXTURES


@pytest.fixture(scope="module")
def golden():
    return pd.read_csv(os.path.join(FIXTURES, "golden_monthly_features.csv"))


def test_window_features_replay(spark, golden):
    base = spark.createDataFrame(golden[["period", "total_sales"]])
    out = ts.add_time_series_features(base, "total_sales", [1, 2, 3], [2, 3]).toPandas()
    out = out.sort_values("period").reset_index(drop=True)
    for col in golden.columns:
        if not col.startswith("total_sales_"):
            continue
        exp, got = golden[col].to_numpy(), out[col].to_numpy()
        tol = 1e-6 if "_std_" in col else 1e-8
        assert abs(exp - got).max() <= tol * max(1.0, abs(exp).max()), col


def test_calendar_replay(spark, golden):
    df = spark.createDataFrame(golden[["date"]]).select(F.to_date("date").alias("d"))
    cal = calendar_columns("d")
    got = df.select("d", cal["day_of_week"].alias("dow"), cal["week_of_year"].alias("woy")).toPandas()
    assert got["dow"].tolist() == golden["day_of_week"].tolist()
    assert got["woy"].tolist() == golden["week_of_year"].tolist()


def test_prediction_record_change_percent():
    # Golden prediction record: (793032.3125 - 68157.65) / 68157.65 * 100
    assert abs((793032.3125 - 68157.65) / 68157.65 * 100 - 1063.5264896897122) < 1e-9
