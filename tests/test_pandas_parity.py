"""Parity with pandas - the reference's engine - on random data with NaNs,
null keys, zero values and one-order periods."""

import numpy as np
import pandas as pd
import pytest

from tidecast.operators import aggregate as agg
from tidecast.operators import timeseries as ts


@pytest.fixture(scope="module")
def orders():
    rng = np.random.default_rng(7)
    n = 600
    days = rng.integers(0, 700, n)
    df = pd.DataFrame({
        "order_id": [str(i) for i in range(n)],
        "order_date": pd.Timestamp("2023-01-01") + pd.to_timedelta(days, unit="D")
                      + pd.to_timedelta(rng.integers(0, 86400, n), unit="s"),
        "order_total": np.round(rng.gamma(2.0, 300.0, n), 2),
        "quantity": rng.integers(1, 6, n).astype(float),
        "customer_id_x": [f"c{i}" for i in rng.integers(0, 80, n)],
        "delivery_time_minutes": rng.normal(20, 8, n).round(1),
        "rating": rng.integers(1, 6, n).astype(float),
        "category": rng.choice(["Baby Care", "Pet Care", "Snacks & Munchies", None], n),
        "customer_segment": rng.choice(["New", "Premium", "Regular"], n),
        "delivery_status_x": rng.choice(["On Time", "Slightly Delayed"], n),
        "sentiment": rng.choice(["Negative", "Positive"], n),
        "payment_method": rng.choice(["Card", "UPI"], n),
    })
    df.loc[rng.choice(n, 40, replace=False), "quantity"] = np.nan
    df.loc[rng.choice(n, 40, replace=False), "rating"] = np.nan
    return df


def _spark_facts(spark, pdf):
    schema = ("order_id string, order_date timestamp_ntz, order_total double, quantity double, "
              "customer_id_x string, delivery_time_minutes double, rating double, category string, "
              "customer_segment string, delivery_status_x string, sentiment string, payment_method string")
    def clean(v):
        if isinstance(v, float) and np.isnan(v):
            return None
        return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
    rows = [tuple(clean(v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("freq", ["daily", "weekly", "monthly"])
def test_period_aggregates_match_pandas(spark, orders, freq):
    d = orders.copy()
    if freq == "daily":
        d["period"] = d.order_date.dt.date
    elif freq == "weekly":
        d["period"] = d.order_date.dt.to_period("W").dt.start_time.dt.date
    else:
        d["period"] = d.order_date.dt.strftime("%Y-%m")
    exp = d.groupby("period").agg(
        order_count=("order_id", "count"), total_sales=("order_total", "sum"),
        avg_order_value=("order_total", "mean"), std_order_value=("order_total", "std"),
        total_quantity=("quantity", "sum"), avg_quantity=("quantity", "mean"),
        unique_customers=("customer_id_x", "nunique"), avg_delivery_time=("delivery_time_minutes", "mean"),
        std_delivery_time=("delivery_time_minutes", "std"), avg_rating=("rating", "mean")).fillna(0)
    got = agg.aggregate_periods(_spark_facts(spark, orders), freq).toPandas().set_index("period")
    got.index = [str(i) for i in got.index]
    exp.index = [str(i) for i in exp.index]
    got = got.loc[exp.index]
    for c in exp.columns:
        np.testing.assert_allclose(got[c].to_numpy(float), exp[c].to_numpy(float), rtol=1e-9, atol=1e-9,
                                   err_msg=c)


def test_pivots_match_pandas_pivot_table(spark, orders):
    d = orders.copy()
    d["period"] = d.order_date.dt.strftime("%Y-%m")
    full = agg.full_dataset(_spark_facts(spark, orders), "monthly").toPandas().set_index("period")
    for spec in agg.PIVOTS:
        g = d.dropna(subset=[spec.column]).groupby(["period", spec.column])
        cell = g["order_total"].sum() if spec.measure == "sum" else g["order_id"].count().astype(float)
        pv = cell.reset_index().pivot_table(index="period", columns=spec.column,
                                            values=cell.name, fill_value=0)
        pv = pv.reindex(full.index).fillna(0)
        for v in pv.columns:
            np.testing.assert_allclose(full[spec.name(v)].to_numpy(float), pv[v].to_numpy(float),
                                       rtol=1e-9, atol=1e-9, err_msg=spec.name(v))


def test_window_features_match_pandas(spark):
    rng = np.random.default_rng(3)
    y = np.round(rng.gamma(2.0, 1000.0, 40), 2)
    y[[5, 6, 20]] = 0.0                                    # zero previous values -> inf/NaN -> 0
    pdf = pd.DataFrame({"period": [f"p{i:03d}" for i in range(40)], "total_sales": y})
    exp = pdf.copy()
    for k in [1, 2, 3, 6]:
        exp[f"total_sales_lag_{k}"] = exp.total_sales.shift(k)
    for k in [2, 3, 6]:
        r = exp.total_sales.rolling(window=k)
        exp[f"total_sales_ma_{k}"], exp[f"total_sales_std_{k}"] = r.mean(), r.std()
        exp[f"total_sales_min_{k}"], exp[f"total_sales_max_{k}"] = r.min(), r.max()
    exp["total_sales_mom_growth"] = exp.total_sales.pct_change(fill_method=None)
    exp["total_sales_yoy_growth"] = exp.total_sales.pct_change(periods=12, fill_method=None)
    exp = exp.replace([np.inf, -np.inf], np.nan).fillna(0)
    got = ts.add_time_series_features(spark.createDataFrame(pdf), "total_sales", [1, 2, 3, 6], [2, 3, 6])
    got = got.toPandas().sort_values("period").reset_index(drop=True)
    for c in exp.columns[1:]:
        np.testing.assert_allclose(got[c].to_numpy(float), exp[c].to_numpy(float), rtol=1e-9, atol=1e-6,
                                   err_msg=c)


def test_sequences_trailing_and_pooled_scaling_match_numpy(spark):
    from tidecast.operators import learn
    from tidecast.operators import sequences as sq
    rng = np.random.default_rng(11)
    n, L = 30, 6
    feats = ["a", "b", "c"]
    X = np.round(rng.normal(100, 20, (n, 3)), 3)
    pdf = pd.DataFrame(X, columns=feats)
    pdf.insert(0, "period", [f"p{i:03d}" for i in range(n)])
    pdf["y"] = np.round(rng.normal(5, 1, n), 3)
    df = spark.createDataFrame(pdf)
    seq = sq.build_sequences(df, feats, "y", L, extras=["a"], same_period_extras=True).orderBy("period").collect()
    assert len(seq) == n - L
    for i, r in enumerate(seq, start=L):                       # X[i] = rows i-L .. i-1, y = y[i]
        np.testing.assert_allclose(np.array(r["x_seq"]), X[i - L:i])
        assert r["y"] == pdf.y[i] and r["x_extra"] == [X[i, 0]]
    # Trailing partial windows, population std (0 for a single value)
    t = ts.trailing_stats(df, "y", 3).orderBy("period").toPandas()
    for i in range(n):
        w = pdf.y.to_numpy()[max(0, i - 2):i + 1]
        assert t["y_tmean_3"][i] == pytest.approx(w.mean())
        assert t["y_tstd_3"][i] == pytest.approx(w.std() if len(w) > 1 else 0.0, abs=1e-12)
    # M3 pooled over timesteps: StandardScaler on X_seq.reshape(-1, F)
    seq_df = sq.build_sequences(df, feats, "y", L)
    (means, stds), _, ylo, yhi = learn._train_stats(seq_df, 3, 0)
    stacked = np.concatenate([X[i - L:i] for i in range(L, n)])
    np.testing.assert_allclose(means, stacked.mean(0), rtol=1e-12)
    np.testing.assert_allclose(stds, stacked.std(0), rtol=1e-9)
    assert (ylo, yhi) == (pdf.y[L:].min(), pdf.y[L:].max())
