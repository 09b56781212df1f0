"""Parameters where the library departs from the reference on purpose, and the flags that restore it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecast.operators import aggregate as agg
from tidecast.operators import learn
from tidecast.operators import sequences as sq
from tidecast.operators import words as wd
from tidecast.params import ForecastParams


@pytest.mark.parametrize("freq,last,kept", [
    ("monthly", dt.date(2024, 2, 28), ["2024-01"]), ("monthly", dt.date(2024, 2, 29), ["2024-01", "2024-02"]),
    ("weekly", dt.date(2024, 1, 13), ["2024-01-01"]), ("weekly", dt.date(2024, 1, 14), ["2024-01-01", "2024-01-08"]),
    ("daily", dt.date(2024, 1, 2), ["2024-01-01", "2024-01-02"])])
def test_unfinished_last_period_goes(spark, freq, last, kept):
    facts = spark.createDataFrame([(dt.date(2024, 1, 1),), (last,), (None,)], "order_date date")
    labels = {"monthly": F.date_format("order_date", "yyyy-MM"), "weekly": F.date_sub("order_date", F.weekday("order_date")), "daily": F.col("order_date")}
    periods = facts.where("order_date is not null").select(labels[freq].alias("period"), F.lit(1).alias("n"))
    got = agg.drop_partial_last(periods, facts, freq)
    assert got.columns == ["period", "n"]
    assert sorted(str(r["period"]) for r in got.collect()) == kept
    assert agg.drop_partial_last(periods, facts.where("order_date is null"), freq).count() == 0
    assert agg.drop_partial_last(periods.limit(0), facts, freq).count() == 0


def made_series(spark, n=12):
    return spark.createDataFrame([(k, i, float(10 * k + i), float(i % 3)) for k in (1, 2) for i in range(n + k)], "series int, period int, a double, extra double")


def test_last_training_window_is_the_newest_sample(spark):
    seq = sq.build_sequences(made_series(spark), ["a"], "a", 3, extras=["extra"], series_keys=["series"])
    got = {r["series"]: r for r in sq.last_training_window(seq, series_keys=["series"]).collect()}
    assert sorted(got) == [1, 2] and sq.last_training_window(seq, series_keys=["series"]).columns == seq.columns
    assert (got[1]["period"], got[1]["y"], got[1]["x_seq"]) == (12, 22.0, [[19.0], [20.0], [21.0]])
    assert (got[2]["period"], got[2]["y"], got[2]["x_extra"]) == (13, 33.0, [1.0])
    one = seq.where("series = 1").drop("series")
    assert [r["period"] for r in sq.last_training_window(one).collect()] == [12]
    assert sq.last_training_window(one.limit(0)).count() == 0


def monthly(spark, n=30):
    rows = [(f"{2020 + i // 12}-{i % 12 + 1:02d}", 100.0 + 7 * (i % 5) + (500.0 if i > 24 else 0.0), 3 + i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "period string, total_sales double, order_count long")


def test_parity_flags_of_the_forecast(spark):
    full = monthly(spark)
    pred, rec = learn.forecast(full, ForecastParams(next_from_training=True), "huber")
    newest = pred.orderBy(F.desc("period")).first()
    assert rec["predicted_value"] == pytest.approx(newest["y_pred"], rel=1e-9) and newest["period"] == rec["last_period"]
    _, ours = learn.forecast(full, ForecastParams(), "huber")
    _, every = learn.forecast(full, ForecastParams(scale_on_all=True), "huber")
    assert ours["_state"]["yhi"] < 500 < every["_state"]["yhi"]              # the jump lies in the validation suffix
    assert every["_state"]["seq_stats"][0] != ours["_state"]["seq_stats"][0]


def words_and_sales(spark):
    months = [f"2024-{m:02d}" for m in range(1, 9)]
    words = [(m, w) for i, m in enumerate(months) for w in (["up"] if i % 2 else ["down"]) + (["late"] if i > 5 else [])]
    sales = [(dt.date(2024, i + 1, 1), 100.0 + 50 * (i % 2) + i) for i in range(8)]
    return spark.createDataFrame(words, "month string, word string"), spark.createDataFrame(sales, "month date, sales double")


def test_direction_of_a_tree_by_correlation(spark):
    words, sales = words_and_sales(spark)
    plain = {r["word"]: r for r in learn.word_importance(words, sales, "random_forest").collect()}
    turned = {r["word"]: r for r in learn.word_importance(words, sales, "random_forest", direction_source="corr").collect()}
    by_corr = {r["word"]: r["direction"] for r in wd.correlation_scores(words, sales).collect()}
    assert by_corr["up"] == "positive" and by_corr["down"] == "negative"
    assert {w: r["direction"] for w, r in turned.items()} == by_corr
    assert {w: r["score"] for w, r in turned.items()} == {w: r["score"] for w, r in plain.items()}
    assert all(r["raw_importance"] >= 0 for r in plain.values())
    with pytest.raises(ValueError):
        learn.word_importance(words, sales, "ridge", direction_source="guess")


def test_word_offset_learns_from_the_target_month(spark):
    """Sales that follow the month's own word are forecast by offset 0; offset 1 sees the month before."""
    months = [dt.date(2018 + i // 12, i % 12 + 1, 1) for i in range(60)]
    on = [(i * i // 3 + i // 7) % 2 for i in range(61)]
    matrix = spark.createDataFrame([(m, 100.0 + 80 * on[i], float(on[i])) for i, m in enumerate(months)], "month date, sales double, word_score_w double")
    ahead = spark.createDataFrame([("w", 1.0)], "word string, score double")
    errors = [learn.word_forecast(matrix, ahead, length=3, word_offset=k)["MAE"] for k in (0, 1)]
    assert errors[0] < 10 < errors[1]
    rec = learn.word_forecast(matrix, ahead, length=3, word_offset=0)
    again = learn.word_forecast(matrix, ahead, length=3, saved=(rec["_model"], rec["_state"]))
    assert again["predicted_value"] == pytest.approx(rec["predicted_value"], rel=1e-9) and abs(rec["predicted_value"] - 180) < 20
    with pytest.raises(ValueError):
        learn.word_forecast(matrix, ahead, word_offset=2)
