"""Registered queries backed by Spark ML.

A fitted model itself can't be written in SQL.  What defines it can: the
optimality condition of each coefficient, the sum of importances, and the parts of a
forecast record that follow from the tables.  The queries return those.
"""

from __future__ import annotations

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import learn
from ..operators import words as wd
from ..operators.word_sequences import sparse_word_forecast
from ..params import SEQUENCE_FEATURES, SEQUENCE_LENGTH_PRESETS, VALIDATION_SHARE, WORD_SEQUENCE_LENGTH, ForecastParams
from ..session import materialise, scratch_path
from ..sources import sinks
from ..sources.tables import monthly_sales, order_facts, shared_word_lists, shared_word_scores
from .queries_words import wsql
from .registry import comparable, register


def _word_importance(method):
    def q(spark, sf_dir):
        words, sales = shared_word_lists(spark, sf_dir), materialise(monthly_sales(spark, sf_dir), "month-sales")
        return comparable(learn.importance_checks(words, sales, method))
    return q


for _short, _method in (("ridge", "ridge"), ("lasso", "lasso"), ("rf", "random_forest"),
                        ("gbt", "gradient_boosting")):
    register(f"word_importance_{_short}", wsql("SELECT word, CAST(0 AS FLOAT) AS violation, TRUE AS valid FROM vocab"))(
        _word_importance(_method))


def _checked(spark, rec):
    """The record's columns that follow from the tables, and identities of the others."""
    df = learn.record_frame(spark, [rec])
    change = (F.col("predicted_value") - F.col("last_value")) / F.col("last_value") * 100
    return comparable(df.select(
        "freq", "model", "status", "n_samples", "last_period", "last_value",
        (F.abs(F.col("RMSE") * F.col("RMSE") - F.col("MSE")) <= 1e-6 * F.col("MSE")).alias("rmse_is_root"),
        ((F.col("MAE") <= F.col("RMSE") * (1 + 1e-9)) & (F.col("R2") <= 1)).alias("metrics_in_range"),
        (F.abs(F.col("change_percent") - change) <= 1e-6 * F.abs(change) + 1e-9).alias("change_agrees"),
        F.col("error").isNull().alias("no_error")))


def _record_sql(model, source, length):
    return f"""
SELECT 'monthly' AS freq, '{model}' AS model, 'success' AS status, count(*) - {length} AS n_samples,
       max(period) AS last_period, CAST(arg_max(value, period) AS FLOAT) AS last_value,
       TRUE AS rmse_is_root, TRUE AS metrics_in_range, TRUE AS change_agrees, TRUE AS no_error
FROM ({source}) t"""


_MONTHLY = "SELECT strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1"


def _forecast(model, freq="monthly"):
    def q(spark, sf_dir):
        _, rec = learn.forecast_from_facts(order_facts(spark, sf_dir), ForecastParams(freq=freq), model)
        return _checked(spark, rec)
    return q


for _model in ("gbt", "huber"):
    register(f"forecast_{_model}", _record_sql(_model, _MONTHLY, SEQUENCE_LENGTH_PRESETS["monthly"]))(_forecast(_model))


@register("forecast_words", _record_sql("words_linear", _MONTHLY, WORD_SEQUENCE_LENGTH))
def forecast_words(spark, sf_dir):
    """Pipeline C: word-score matrix + sales sequences -> next month's sales."""
    scores = shared_word_scores(spark, sf_dir).select("month", "word", "score")
    sales = materialise(monthly_sales(spark, sf_dir), "month-sales")
    matrix = wd.word_score_matrix(sales, scores)
    return _checked(spark, learn.word_forecast(matrix, wd.next_month_vector(scores, sales)))


_SPARSE_SQL = wsql(f"""
, mon AS ({_MONTHLY})
SELECT word, CAST(0 AS FLOAT) AS violation, (SELECT count(*) - {WORD_SEQUENCE_LENGTH} FROM mon) AS n_samples,
       (SELECT max(period) FROM mon) AS last_period, CAST((SELECT arg_max(value, period) FROM mon) AS FLOAT) AS last_value,
       CAST(0 AS FLOAT) AS dual_miss
FROM vocab_all""")


def _sparse_words(word_offset):
    def q(spark, sf_dir):
        """M14 without a wide matrix: each word's miss of the normal equations, and of the dual's predictions from the coefficients'."""
        scores = shared_word_scores(spark, sf_dir).select("month", "word", "score")
        sales = materialise(monthly_sales(spark, sf_dir), "month-sales")
        rec, words = sparse_word_forecast(scores, sales, wd.next_month_vector(scores, sales), WORD_SEQUENCE_LENGTH, word_offset=word_offset)
        return comparable(words.select("word", F.round("violation", 5).alias("violation"), F.lit(rec["n_samples"]).cast("bigint").alias("n_samples"),
                                       F.lit(rec["last_period"]).alias("last_period"), F.lit(rec["last_value"]).alias("last_value"),
                                       F.round(F.lit(rec["dual_miss"]), 6).alias("dual_miss")))
    return q


register("forecast_words_sparse", _SPARSE_SQL)(_sparse_words(1))
register("forecast_words_same_month", _SPARSE_SQL)(_sparse_words(0))       # D7: learned from the target month's own words


@register("word_direction_by_correlation", wsql("SELECT word, direction FROM imp"))
def word_direction_by_correlation(spark, sf_dir):
    """A tree model's words with the directions of their correlations."""
    words, sales = shared_word_lists(spark, sf_dir), materialise(monthly_sales(spark, sf_dir), "month-sales")
    return learn.word_importance(words, sales, "random_forest", direction_source="corr").select("word", "direction")


@register("forecast_huber_parity", _record_sql("huber", _MONTHLY, SEQUENCE_LENGTH_PRESETS["monthly"]).replace(f"count(*) - {SEQUENCE_LENGTH_PRESETS['monthly']} AS n_samples", f"count(*) - {SEQUENCE_LENGTH_PRESETS['monthly']} AS n_samples, TRUE AS predicts_last_window"))
def forecast_huber_parity(spark, sf_dir):
    """D3, D4, D14 as in the reference: same-period extras, scalers of all windows, the prediction of the last training window."""
    p = ForecastParams(freq="monthly", same_period_extras=True, next_from_training=True, scale_on_all=True)
    pred, rec = learn.forecast_from_facts(order_facts(spark, sf_dir), p, "huber")
    newest = pred.agg(F.max_by("y_pred", "period").alias("newest"))
    same = F.abs(F.col("newest") - F.lit(rec["predicted_value"])) <= 1e-6 * F.abs("newest")
    return wd.with_scalars(_checked(spark, rec), newest).select("*", same.alias("predicts_last_window")).drop("newest")


_HUBER_CELLS = ("SELECT * FROM (SELECT unnest(range(%d)) AS step) s" % (SEQUENCE_LENGTH_PRESETS["monthly"] * len(SEQUENCE_FEATURES)))


@register("forecast_huber_optimality", f"SELECT CAST(step AS INTEGER) AS step, CAST(0 AS FLOAT) AS violation FROM ({_HUBER_CELLS} UNION ALL SELECT -1) c")
def forecast_huber_optimality(spark, sf_dir):
    """Each window coefficient's (and the intercept's, step -1) miss of the minimum's condition; every other coefficient must meet it too."""
    full, p = materialise(agg.full_dataset(order_facts(spark, sf_dir), "monthly"), "full-dataset"), ForecastParams(freq="monthly")
    _, rec = learn.forecast(full, p, "huber")
    checked = learn.huber_optimality(learn.training_windows(full, rec["_state"], p), rec["_model"])
    own = F.col("step") < rec["_state"]["length"] * len(rec["_state"]["features"])
    return comparable(checked.select("step", F.round("violation", 6).alias("violation")).where(own | (F.col("violation") > 0)))


@register("forecast_huber_windows", f"""
WITH m AS ({_MONTHLY}), t AS (SELECT period, value, row_number() OVER (ORDER BY period) AS rn, count(*) OVER () - {SEQUENCE_LENGTH_PRESETS["monthly"]} AS n FROM m)
SELECT period, CAST(value AS FLOAT) AS y, rn - {SEQUENCE_LENGTH_PRESETS["monthly"]} > floor(n * {1.0 - VALIDATION_SHARE}) AS is_val, TRUE AS metrics_agree
FROM t WHERE rn > {SEQUENCE_LENGTH_PRESETS["monthly"]}""")
def forecast_huber_windows(spark, sf_dir):
    """The written prediction of every window; the record's metrics are computed from it again, in another form."""
    pred, rec = learn.forecast_from_facts(order_facts(spark, sf_dir), ForecastParams(freq="monthly"), "huber")
    pred = materialise(pred, "window-predictions")
    e, y = F.col("y") - F.col("y_pred"), F.col("y")
    again = pred.agg(F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"), (1 - F.avg(e * e) / F.var_pop(y)).alias("R2"),
                     (F.avg(F.abs(e / y)) * 100).alias("MAPE"), F.avg(F.when(F.col("is_val"), F.abs(e))).alias("holdout_MAE"))
    agree = F.lit(True)
    for c in again.columns:
        agree = agree & (F.abs(F.col(c) - F.lit(rec[c])) <= 1e-6 * F.abs(F.col(c)))
    return comparable(wd.with_scalars(pred, again).select("period", "y", "is_val", agree.alias("metrics_agree")))


@register("forecast_saved_state", _record_sql("huber", _MONTHLY, SEQUENCE_LENGTH_PRESETS["monthly"]))
def forecast_saved_state(spark, sf_dir):
    """SNK7 + M19: a model is saved, a newer save ends half-way, and the forecast runs on what loads."""
    full = materialise(agg.full_dataset(order_facts(spark, sf_dir), "monthly"), "full-dataset")
    p, base = ForecastParams(freq="monthly"), scratch_path(spark, "saved-models")
    _, rec = learn.forecast(full, p, "huber")
    sinks.save_model(rec["_model"], base, state=rec["_state"])
    rec["_model"].write().save(f"{base}/model_99991231_235959_000000_unfinished/model")
    _, again = learn.forecast(full, p, "huber", saved=sinks.load_latest(spark, base, LinearRegressionModel))
    if abs(again["predicted_value"] - rec["predicted_value"]) > 1e-6 * abs(rec["predicted_value"]):
        raise AssertionError("the loaded model predicts something else")
    return _checked(spark, again)
