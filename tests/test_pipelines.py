"""End-to-end pipelines and the remaining small operators."""

import datetime as dt
import json
import math
import os

from pyspark.sql import functions as F

from tidecast.functions.calendar import next_month_string, time_feature_array
from tidecast.operators import aggregate as agg
from tidecast.operators import items as it
from tidecast.operators import words as wd
from tidecast.params import ForecastParams
from tidecast.plans import pipelines
from tidecast.sources.tables import items_from_events, monthly_sales, monthly_word_lists, order_facts

from .conftest import SF_SMALL


def test_time_feature_array_and_next_month(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 15),), (None,)], "ts timestamp_ntz")
    rows = df.select(time_feature_array("ts").alias("a"), next_month_string("ts").alias("n")).collect()
    a = rows[0]["a"]
    assert a[:3] == [12.0, 4.0, 2024.0]
    assert math.isclose(a[3], math.sin(2 * math.pi)) and math.isclose(a[4], 1.0)
    assert rows[0]["n"] == "2025-01"                 # December rolls over
    assert rows[1]["a"] == [0.0] * 5                 # non-timestamps -> zeros


def test_aggregate_monthly_alias(spark):
    m = agg.aggregate_monthly(order_facts(spark, SF_SMALL)).first()
    assert m["year_month"] == m["period"] and m["month"] == m["date"]


def test_multi_hot_vectors_alphabetical(spark):
    words = spark.createDataFrame([("2024-01", "b"), ("2024-01", "a"), ("2024-02", "c")], "month string, word string")
    got = {r["month"]: r["features"].toArray().tolist()
           for r in wd.multi_hot_vectors(words, ["c", "a", "b"]).collect()}
    assert got == {"2024-01": [1.0, 1.0, 0.0], "2024-02": [0.0, 0.0, 1.0]}


def test_in_month_range(spark):
    items = items_from_events(spark, SF_SMALL)
    n_jan = it.in_month(items, 2024, 1).count()
    assert n_jan == items.where(F.month("upload_ts") == 1).count()
    assert it.in_month(items, 2023, 12).count() == 0


def test_demand_forecast_train_then_load(spark, tmpdir_path):
    p = ForecastParams(freq="monthly", max_iter=10)
    rec1 = pipelines.run_demand_forecast(spark, SF_SMALL, tmpdir_path, p, model="huber")
    assert rec1["status"] == "success"
    rec2 = pipelines.run_demand_forecast(spark, SF_SMALL, tmpdir_path, p, model="huber", retrain=False)
    assert math.isclose(rec1["predicted_value"], rec2["predicted_value"], rel_tol=1e-9)
    out = os.path.join(tmpdir_path, "prediction_monthly")
    doc = json.loads(open([os.path.join(out, f) for f in os.listdir(out) if f.endswith(".json")][0]).readline())
    assert doc["status"] == "success" and "evaluation" in doc and doc["prediction"]["freq"] == "monthly"
    assert os.path.isdir(os.path.join(tmpdir_path, "processed", "freq=monthly"))


def test_comparison_marks_one_best(spark):
    frame = pipelines.run_comparison(spark, SF_SMALL, model="huber")
    rows = frame.collect()
    assert [r["freq"] for r in rows] == ["daily", "weekly", "monthly"]
    ok = [r for r in rows if r["status"] == "success"]
    assert sum(bool(r["is_best"]) for r in rows) == (1 if ok else 0)


def test_word_analysis_and_collection(spark, tmpdir_path):
    words, sales = monthly_word_lists(spark, SF_SMALL), monthly_sales(spark, SF_SMALL)
    res = pipelines.run_word_analysis(spark, words, sales, tmpdir_path, method="ridge", top_n=5)
    assert len(res["top_words"]["all"]) == 5 and res["n_months"] > 0
    assert os.path.isdir(os.path.join(tmpdir_path, "report"))
    col = pipelines.run_collection(spark, SF_SMALL, tmpdir_path)
    assert col["n_unique"] <= col["n_collected"]
    rec = pipelines.run_word_forecast(spark, SF_SMALL, tmpdir_path)
    assert rec["status"] in ("success", "insufficient_data")


def test_word_analysis_single_month(spark, tmpdir_path):
    words, sales = monthly_word_lists(spark, SF_SMALL), monthly_sales(spark, SF_SMALL)
    first = words.agg(F.min("month")).first()[0]
    res = pipelines.run_word_analysis(spark, words, sales, tmpdir_path, method="ridge", month=first)
    assert res["n_months"] == 1


def test_reloaded_model_keeps_its_scalers_and_columns(spark, tmpdir_path):
    """Sales times 100 and a new payment value after training: the saved scalers and columns are applied, nothing crashes."""
    p = ForecastParams(freq="monthly", max_iter=10)
    facts = order_facts(spark, SF_SMALL)
    rec1 = pipelines.run_demand_forecast(spark, facts, tmpdir_path, p)
    changed = (facts.withColumn("order_total", F.col("order_total") * 100)
               .withColumn("payment_method", F.when(F.col("order_id") % 7 == 0, "Voucher").otherwise(F.col("payment_method"))))
    rec2 = pipelines.run_demand_forecast(spark, changed, tmpdir_path, p, retrain=False)
    assert rec2["status"] == "success"
    ratio = rec2["predicted_value"] / rec1["predicted_value"]
    assert not math.isclose(ratio, 100, rel_tol=0.02)      # freshly fitted scalers would just scale the prediction
    again = pipelines.run_demand_forecast(spark, facts, tmpdir_path, p, retrain=False)
    assert math.isclose(again["predicted_value"], rec1["predicted_value"], rel_tol=1e-9)


def test_word_forecast_train_then_load(spark, tmpdir_path):
    rec1 = pipelines.run_word_forecast(spark, SF_SMALL, tmpdir_path)
    rec2 = pipelines.run_word_forecast(spark, SF_SMALL, tmpdir_path, retrain=False)
    assert rec1["status"] == "success" and rec1["holdout_MAE"] is not None
    assert math.isclose(rec1["predicted_value"], rec2["predicted_value"], rel_tol=1e-9)


def test_year_filter_ranks_a_hot_keyword_whole(spark):
    rows = [("hot" if i % 3 else "cold", f"{2023 + i % 2}0105", (i * 37) % 101, i) for i in range(3000)]
    items = spark.createDataFrame(rows, "keyword string, upload_date string, view_count long, seq_no long")
    got = {(r["keyword"], r["year"], r["seq_no"]): r["rank"] for r in it.year_filter_top(items).collect()}
    groups = {}
    for k, d, v, s in rows:
        groups.setdefault((k, d[:4]), []).append((-v, s))
    assert got == {(*g, s): n for g, own in groups.items() for n, (_, s) in enumerate(sorted(own), 1)}
