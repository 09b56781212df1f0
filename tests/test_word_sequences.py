"""Sparse word sequences against dense windows and a plain ridge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import word_sequences as ws


def made(spark, months, words, seed, held=0.5):
    rng = np.random.default_rng(seed)
    names = [f"{2020 + i // 12}-{i % 12 + 1:02d}" for i in range(months + 1)]
    x = np.where(rng.random((months + 1, words)) < held, rng.random((months + 1, words)), 0.0)
    x[:, 0] = 0.1                                                                       # never changes
    sales = 100 + 50 * rng.random(months)
    cells = [(names[i], f"w{j}", float(x[i, j])) for i in range(months) for j in range(words) if x[i, j] or j == 1]
    scores = spark.createDataFrame(cells + [("1999-01", "elsewhere", 0.5), (names[0], "unscored", None)], "month string, word string, score double")
    s = spark.createDataFrame([(names[i] + "-01", float(v)) for i, v in enumerate(sales)], "month string, sales double").withColumn("month", F.to_date("month"))
    upcoming = spark.createDataFrame([(f"w{j}", float(x[months, j])) for j in range(words)], "word string, score double")
    return x, sales, scores, s, upcoming


def dense(x, sales, length, train, penalty, offset=1):
    """The same ridge with every window written out: (predictions, coefficients)."""
    months = len(sales)
    rows = np.column_stack([x[:months], sales])
    windows = np.stack([rows[i:i + length] for i in range(months - length + 1)])
    extra = np.stack([*(x[i + length - offset] for i in range(months - length)), x[months]])

    def scaled(a, of):
        std = of.std(0)
        return (a - of.mean(0)) / np.where(std > 1e-12, std, np.inf)

    flat = windows[:train].reshape(-1, rows.shape[1])
    z = np.column_stack([scaled(windows, flat).reshape(len(windows), -1), scaled(extra, extra[:train])])
    y = sales[length:]
    lo, hi = y[:train].min(), y[:train].max()
    y = (y - lo) / (hi - lo)
    zt, centre = z[:train], z[:train].mean(0)
    w = np.linalg.solve((zt - centre).T @ (zt - centre) / train + penalty * np.eye(z.shape[1]), (zt - centre).T @ (y[:train] - y[:train].mean()) / train)
    return ((z - centre) @ w + y[:train].mean()) * (hi - lo) + lo, w


@pytest.mark.parametrize("months,words,length,offset", [(20, 6, 3, 1), (15, 25, 4, 1), (9, 3, 1, 1), (20, 6, 3, 0), (15, 25, 4, 0), (9, 3, 1, 0)])
def test_equals_dense_ridge(spark, months, words, length, offset):
    x, sales, scores, s, upcoming = made(spark, months, words, seed=months)
    record, table = ws.sparse_word_forecast(scores, s, upcoming, length, min_months=3, word_offset=offset)
    train = int((months - length) * 0.8)
    predicted, w = dense(x, sales, length, train, record["penalty"], offset)
    assert record["predicted_value"] == pytest.approx(predicted[-1], rel=1e-9)
    assert record["MAE"] == pytest.approx(np.abs(predicted[:-1] - sales[length:]).mean(), rel=1e-9)
    rows = {r["word"]: r for r in table.collect()}
    steps, extra = w[:length * (words + 1)].reshape(length, words + 1), w[length * (words + 1):]
    for j in range(words):
        assert rows[f"w{j}"]["steps"] == pytest.approx(list(steps[:, j]), abs=1e-9)
        assert rows[f"w{j}"]["extra"] == pytest.approx(extra[j], abs=1e-9)
    assert rows["w0"]["steps"] == [0.0] * length and rows["elsewhere"]["extra"] == 0.0
    assert max(r["violation"] for r in rows.values()) < 1e-8 and record["dual_miss"] < 1e-9


def test_the_path_takes_the_best_penalty_of_the_suffix(spark):
    _, sales, scores, s, upcoming = made(spark, 24, 10, seed=5)
    design = ws.SequenceDesign(scores, s, upcoming, 4)
    k = design.products()
    errors = [float(np.mean((design.solve(k, p)[1][design.train:-1] - design.y[design.train:]) ** 2)) for p in ws.PENALTIES]
    best = design.fit(patience=len(ws.PENALTIES))
    assert best["error"] == min(errors) and best["penalty"] == ws.PENALTIES[int(np.argmin(errors))]


def test_too_few_months_and_no_rows(spark):
    _, _, scores, s, upcoming = made(spark, 8, 3, seed=1)
    assert ws.sparse_word_forecast(scores, s, upcoming, 12)[0]["status"] == "insufficient_data"
    assert ws.sparse_word_forecast(scores.limit(0), s.limit(0), upcoming.limit(0), 3)[0]["status"] == "insufficient_data"


def test_fifty_thousand_words(spark):
    """Far more words than a frame has columns, and nothing as long as the vocabulary on the driver."""
    months, words = 24, 50_000
    s = spark.range(months).select(F.add_months(F.lit("2022-01-01").cast("date"), F.col("id").cast("int")).alias("month"),
                                   (100 + (F.col("id") * 37) % 50).cast("double").alias("sales"))
    grid = spark.range(words * months).select((F.col("id") % months).cast("int").alias("i"), F.floor(F.col("id") / months).alias("w"))
    cells = grid.where(F.pmod(F.xxhash64("i", "w"), F.lit(10)) < 2)
    scores = cells.select(F.date_format(F.add_months(F.lit("2022-01-01").cast("date"), F.col("i")), "yyyy-MM").alias("month"),
                          F.concat(F.lit("w"), "w").alias("word"), ((F.pmod(F.xxhash64("w", "i"), F.lit(1000)) + 1) / 1000).alias("score"))
    record, table = ws.sparse_word_forecast(scores, s, scores.where("month = '2023-12'").select("word", "score"), 6)
    row = table.agg(F.count(F.lit(1)).alias("n"), F.max("violation").alias("worst")).first()
    assert record["status"] == "success" and row["n"] > 49_000 and row["worst"] < 1e-6
