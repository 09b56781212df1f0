"""Word operators: vocabulary index, explanations, importance models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import explain as ex
from tidecast.operators import learn
from tidecast.operators import words as wd
from tidecast.operators.indexing import dense_index
from tidecast.sources.tables import monthly_sales, monthly_word_lists

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def inputs(spark):
    return monthly_word_lists(spark, SF_SMALL).persist(), monthly_sales(spark, SF_SMALL).persist()


def test_dense_index_is_dense_and_sorted(spark):
    words = spark.createDataFrame([(w,) for w in "pear apple fig apple kiwi date".split()], "w string")
    got = [(r["w"], r["idx"]) for r in dense_index(words.repartition(4), "w").orderBy("idx").collect()]
    assert got == [("apple", 0), ("date", 1), ("fig", 2), ("kiwi", 3), ("pear", 4)]


def _design_numpy(spark, inputs):
    x, vocab, n, n_words = learn.word_design(*inputs)
    vocab = [r["word"] for r in vocab.orderBy("idx").collect()]
    assert len(vocab) == n_words
    rows = x.orderBy("month").collect()
    X = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["y"] for r in rows])
    return X, y, vocab


def test_ridge_matches_closed_form(spark, inputs):
    X, y, vocab = _design_numpy(spark, inputs)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + learn.RIDGE_ALPHA * np.eye(X.shape[1]), Xc.T @ yc)
    got = {r["word"]: r["raw_importance"] for r in learn.word_importance(*inputs, "ridge").collect()}
    spark_w = np.array([got[v] for v in vocab])
    assert np.abs(spark_w - w).max() <= 1e-6 * max(1.0, np.abs(w).max())


def test_lasso_matches_coordinate_descent(spark, inputs):
    X, y, vocab = _design_numpy(spark, inputs)
    Xc, yc = X - X.mean(0), y - y.mean()
    n, p = Xc.shape
    w = np.zeros(p)
    for _ in range(5000):
        for j in range(p):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            z = Xc[:, j] @ Xc[:, j] / n
            w[j] = 0.0 if z == 0 else np.sign(rho) * max(abs(rho) - learn.LASSO_ALPHA, 0) / z
    got = {r["word"]: r["raw_importance"] for r in learn.word_importance(*inputs, "lasso").collect()}
    spark_w = np.array([got[v] for v in vocab])
    assert np.abs(spark_w - w).max() <= 1e-3 * max(1.0, np.abs(w).max())


@pytest.mark.parametrize("method", ["random_forest", "gradient_boosting"])
def test_tree_importances_are_normalised(spark, inputs, method):
    rows = learn.word_importance(*inputs, method).collect()
    scores = [r["score"] for r in rows]
    assert len(rows) == 16 and min(scores) >= 0 and max(scores) == pytest.approx(1.0)
    assert all(r["direction"] in ("positive", "negative") for r in rows)


def test_correlation_matches_numpy(spark, inputs):
    words, sales = inputs
    got = {r["word"]: r["raw_importance"] for r in wd.correlation_scores(words, sales).collect()}
    t = wd.training_set(words, sales).orderBy("month").collect()
    y = np.array([r["sales"] for r in t])
    for word, r in got.items():
        x = np.array([1.0 if word in row["words"] else 0.0 for row in t])
        exp = 0.0 if x.std() == 0 else np.corrcoef(x, y)[0, 1]
        assert r == pytest.approx(exp, abs=1e-9)


def test_summary_default_sentence(spark):
    empty = F.array().cast("array<struct<rank:int,word:string,score:double,direction:string,impact:string>>")
    got = spark.range(1).select(ex.summary(empty, empty).alias("s")).first()["s"]
    assert got == ex.NO_FACTOR_SENTENCE


def _explained(spark, rows):
    factor = "array<struct<rank:int,word:string,score:double,direction:string,impact:string>>"
    return spark.createDataFrame(rows, "month string, predicted_sales double, actual_sales double, "
                                 f"top_positive_factors {factor}, top_negative_factors {factor}, summary string")


def test_report_formatting_python_rounding(spark):
    up = [(1, "a", 0.825, "positive", "high")]
    txt = ex.report_lines(_explained(spark, [("2024-01", 1234567.5, 1000.0, up, [], "s")])).first()["report"]
    assert "1,234,568" in txt and "0.82" in txt        # correctly rounded, not half-up on decimals
    assert ex.FALL_HEADER not in txt


def test_report_error_line_and_missing_actual(spark):
    rows = [("2024-01", 900.0, 1200.0, [], [], "s"), ("2024-02", 1300.5, 1200.0, [], [(1, "b", 0.4, "negative", "medium")], "s"),
            ("2024-03", 10.0, None, [], [], "s")]
    got = [r["report"] for r in ex.report_lines(_explained(spark, rows)).orderBy("month").collect()]
    for (_, pred, actual, *_), txt in zip(rows, got):
        if actual is None:
            assert ex.ERROR_LINE.split("{")[0] not in txt
        else:
            assert ex.ERROR_LINE.format(diff=f"{pred - actual:,.0f}", pct=f"{(pred - actual) / actual * 100:+.1f}") in txt
    assert ex.FALL_HEADER in got[1] and "0.40" in got[1]


def test_predictions_replace_actuals_in_explanations(spark, inputs):
    words, sales = inputs
    month = words.agg(F.min("month")).first()[0]
    predictions = spark.createDataFrame([(month, 123.0)], "month string, predicted double")
    e = ex.explanations(words, wd.correlation_scores(words, sales), sales, predictions)
    r = e.where(F.col("month") == month).first()
    assert r["predicted_sales"] == 123.0 and r["actual_sales"] != 123.0


def test_word_feature_vectors(spark, inputs):
    words, sales = inputs
    m = wd.word_score_matrix(sales, words.select("month", "word", "score"))
    v = wd.word_feature_vectors(m)
    cols = sorted(c for c in m.columns if c.startswith("word_score_"))
    r = v.orderBy("month").first()
    assert r["features"].toArray().tolist() == [r[c] for c in cols]


def test_fifty_thousand_words(spark):
    """No ceiling on the vocabulary: sparse features, no literal per word."""
    from tidecast.operators import learn
    rows = [(f"2024-{m:02d}", f"w{(i * 7919 + m * 13) % 50_000:05d}") for m in range(1, 9) for i in range(9_000)]
    words = spark.createDataFrame(rows, "month string, word string").distinct()
    sales = spark.sql("SELECT make_date(2024, cast(id AS int), 1) AS month, cast(100 + id * id AS double) AS sales FROM range(1, 9)")
    imp = learn.word_importance(words, sales, "lasso")
    assert imp.count() == words.select("word").distinct().count() > 40_000
    assert imp.where("score < 0 or score > 1").count() == 0


def _wide(spark, n_months, n_words, seed):
    """(month, word) rows with many more words than months, in Spark, and the presence matrix."""
    rng = np.random.default_rng(seed)
    X = (rng.random((n_months, n_words)) < rng.uniform(0.05, 0.95, n_words)).astype(float)
    X[np.arange(n_words) % n_months, np.arange(n_words)] = 1        # no word without a month
    X[:, 1] = X[:, 0]                                   # equal columns
    X[:, 2] = 1.0                                       # a constant one
    y = 1000 + X[:, 3:9] @ np.array([300.0, -200, 150, 80, -60, 40]) + rng.normal(size=n_months) * 20
    rows = [(f"{2000 + m // 12}-{m % 12 + 1:02d}", f"w{j:05d}") for m, j in zip(*np.nonzero(X))]
    words = spark.createDataFrame(rows, "month string, word string")
    sales = spark.createDataFrame([(f"{2000 + m // 12}-{m % 12 + 1:02d}-01", float(v)) for m, v in enumerate(y)], "month string, sales double")
    return words, sales.withColumn("month", F.to_date("month")), X, y


def test_more_words_than_months(spark):
    """Dual ridge equals the closed form, and lasso the objective of coordinate descent, at p > n."""
    words, sales, X, y = _wide(spark, 24, 150, 1)
    std = X.std(0)
    Z = np.where(std > 0, (X - X.mean(0)) / np.where(std > 0, std, 1), 0)
    yc = y - y.mean()
    got = {r["word"]: r["raw_importance"] for r in learn.word_importance(words, sales, "ridge").collect()}
    want = np.linalg.solve(Z.T @ Z + learn.RIDGE_ALPHA * np.eye(Z.shape[1]), Z.T @ yc)
    assert np.allclose([got[f"w{j:05d}"] for j in range(Z.shape[1])], want, rtol=1e-6, atol=1e-6)
    got = {r["word"]: r["raw_importance"] for r in learn.word_importance(words, sales, "lasso").collect()}
    w = np.array([got[f"w{j:05d}"] for j in range(Z.shape[1])])
    gradient = Z.T @ (yc - Z @ w) / len(y)
    assert (np.abs(gradient) <= learn.LASSO_ALPHA * (1 + 1e-4) + 1e-6 * np.abs(yc).mean()).all()
    assert np.allclose(gradient[w != 0], learn.LASSO_ALPHA * np.sign(w[w != 0]), atol=1e-6 * np.abs(yc).mean())
    assert (w != 0).sum() <= len(y)


@pytest.mark.parametrize("method", ["ridge", "lasso"])
def test_vocabulary_of_200_000_words(spark, method):
    """Far more words than fit a dense design: no vocabulary on the driver, every condition holds."""
    words = (spark.range(200_000, numPartitions=8).withColumn("word", F.concat(F.lit("w"), "id"))
             .withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(23))))
             .where(F.pmod(F.xxhash64("id", "m"), F.lit(100)) < 10 + F.pmod(F.xxhash64("id"), F.lit(60)))
             .select(F.format_string("%d-%02d", (2000 + F.floor(F.col("m") / 12)).cast("int"), F.col("m") % 12 + 1).alias("month"), "word"))
    sales = spark.createDataFrame([(f"{2000 + m // 12}-{m % 12 + 1:02d}-01", 1000.0 + 37 * ((m * 7) % 11)) for m in range(24)],
                                  "month string, sales double").withColumn("month", F.to_date("month"))
    checks = learn.importance_checks(words, sales, method)
    counts = checks.agg(F.count(F.lit(1)), F.count_if(F.expr("violation > 0 or not valid"))).first()
    assert counts[0] == words.select("word").distinct().count() > 198_000
    assert counts[1] == 0
