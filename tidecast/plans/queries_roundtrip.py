"""Registered queries: readers and sinks as write-then-read round trips through
the shared folder, and the operators that no other query exercises."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.calendar import time_feature_array
from ..operators import explain as ex
from ..operators import items as it
from ..operators import sequences as sq
from ..operators import words as wd
from ..session import materialise, scratch_path
from ..sources import files, sinks
from ..sources.tables import items_from_events, monthly_sales, shared_word_lists, shared_word_scores, table
from .queries_items import isql
from .queries_series import periods, pt_sql
from .queries_words import TEST_VOCABULARY, wsql
from .registry import comparable, register


# --- F3, PF8, S1 ---------------------------------------------------------------------
@register("time_features", """
SELECT o_orderkey, CAST(month(o_orderdate) AS FLOAT) AS f_month, CAST(quarter(o_orderdate) AS FLOAT) AS f_quarter,
       CAST(year(o_orderdate) AS FLOAT) AS f_year, CAST(round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS FLOAT) AS f_sin,
       CAST(round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS FLOAT) AS f_cos
FROM orders WHERE o_orderdate IS NOT NULL""")
def time_features(spark, sf_dir):
    """the five time features of every order date."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate is not null")
    a = orders.select("o_orderkey", time_feature_array("o_orderdate").alias("f"))
    return comparable(a.select("o_orderkey", F.col("f")[0].alias("f_month"), F.col("f")[1].alias("f_quarter"), F.col("f")[2].alias("f_year"),
                               (F.round(F.col("f")[3], 6) + 0.0).alias("f_sin"), (F.round(F.col("f")[4], 6) + 0.0).alias("f_cos")))


@register("items_in_month", isql("""
SELECT keyword, url, seq_no, view_count FROM items WHERE upload_ts >= DATE '2024-01-01' AND upload_ts < DATE '2024-02-01'"""))
def items_in_month(spark, sf_dir):
    """PF8: items published in one month."""
    return it.in_month(items_from_events(spark, sf_dir), 2024, 1).select("keyword", "url", "seq_no", "view_count")


@register("items_union_dedupe", isql("""
, u AS (SELECT url, seq_no, keyword, view_count FROM items UNION ALL
        SELECT url, seq_no + 1000000000, keyword, 0 FROM items WHERE view_count > 50)
SELECT url, min(seq_no) AS seq_no, arg_min(keyword, seq_no) AS keyword, arg_min(view_count, seq_no) AS view_count
FROM u GROUP BY url"""))
def items_union_dedupe(spark, sf_dir):
    """S1 + S2: two collected lists joined to one, then the first item of every URL."""
    first = items_from_events(spark, sf_dir).select("url", "seq_no", "keyword", "view_count")
    second = first.where("view_count > 50").select("url", (F.col("seq_no") + 1_000_000_000).alias("seq_no"), "keyword",
                                                   F.lit(0).cast("bigint").alias("view_count"))
    return it.dedupe_first(it.union_lists(first, second))


# --- M2, W9 extras, next window --------------------------------------------------------
@register("word_feature_vectors", wsql("""
, cells AS (SELECT s.month, i.idx, i.word FROM sales s, (SELECT unnest({words}) AS word, unnest(range({n})) AS idx) i)
SELECT CAST(c.month AS VARCHAR) AS month, CAST(c.idx AS INTEGER) AS idx, CAST(coalesce(wa.score, 0) AS FLOAT) AS value
FROM cells c LEFT JOIN wa ON wa.month = strftime(c.month, '%Y-%m') AND wa.word = c.word""".format(
    words=TEST_VOCABULARY, n=len(TEST_VOCABULARY))))
def word_feature_vectors(spark, sf_dir):
    """M2: a month's word scores as one vector, listed by index."""
    scores = shared_word_scores(spark, sf_dir).select("month", "word", "score")
    v = wd.word_feature_vectors(wd.word_score_matrix(monthly_sales(spark, sf_dir), scores))
    return comparable(v.select("month", F.posexplode(vector_to_array("features")).alias("idx", "value")))


@register("sequence_extras", pt_sql("""
SELECT period, CAST(total_sales AS FLOAT) AS y, CAST(order_count AS FLOAT) AS same_0, CAST(total_quantity AS FLOAT) AS same_1,
       CAST(lag(order_count) OVER (ORDER BY period) AS FLOAT) AS lag_0,
       CAST(lag(total_quantity) OVER (ORDER BY period) AS FLOAT) AS lag_1
FROM pt QUALIFY row_number() OVER (ORDER BY period) > 6"""))
def sequence_extras(spark, sf_dir):
    """Extra features of the target period itself and of the period before."""
    p = materialise(periods(spark, sf_dir), "periods")
    args = (["total_sales"], "total_sales", 6)
    same = sq.build_sequences(p, *args, extras=["order_count", "total_quantity"], same_period_extras=True)
    lag = sq.build_sequences(p, *args, extras=["order_count", "total_quantity"], same_period_extras=False)
    e = F.col("x_extra")
    return comparable(same.select("period", "y", e[0].alias("same_0"), e[1].alias("same_1"))
                      .join(lag.select("period", e[0].alias("lag_0"), e[1].alias("lag_1")), "period"))


@register("next_window", pt_sql("""
SELECT CAST(row_number() OVER (ORDER BY period) AS INTEGER) AS step, CAST(total_sales AS FLOAT) AS value
FROM (SELECT * FROM pt ORDER BY period DESC LIMIT 6) t"""))
def next_window(spark, sf_dir):
    """The input window for the period after the last one."""
    nxt = sq.next_window(periods(spark, sf_dir), ["total_sales"], 6)
    return comparable(nxt.select(F.posexplode("x_seq").alias("i", "row")).select((F.col("i") + 1).alias("step"), F.col("row")[0].alias("value")))


# --- J5, F8 ---------------------------------------------------------------------------
@register("explain_with_predictions", wsql("""
, p AS (SELECT month, 1.1 * sales + 0.5 AS predicted FROM tr WHERE month < (SELECT max(month) FROM tr))
SELECT m.month, CAST(coalesce(p.predicted, sm.sales) AS FLOAT) AS predicted_sales, CAST(sm.sales AS FLOAT) AS actual_sales,
       '오차: ' || format('{:,.0f}', coalesce(p.predicted, sm.sales) - sm.sales) || '원 ('
       || format('{:+.1f}', (coalesce(p.predicted, sm.sales) - sm.sales) / sm.sales * 100) || '%)' AS error_line
FROM (SELECT DISTINCT month FROM wl) m JOIN sm ON sm.month_str = m.month LEFT JOIN p ON p.month = m.month
WHERE sm.sales <> 0"""))
def explain_with_predictions(spark, sf_dir):
    """J5 + F8: explanations with predictions for all months but the last; the report's error line."""
    words, sales = shared_word_lists(spark, sf_dir), materialise(monthly_sales(spark, sf_dir), "month-sales")
    train = wd.training_set(words, sales).select("month", "sales")
    last = train.agg(F.max("month").alias("last"))
    predicted = (wd.with_scalars(train, last).where("month < last")
                 .select("month", (F.col("sales") * 1.1 + 0.5).alias("predicted")))
    e = ex.explanations(words, wd.correlation_scores(words, sales), sales, predicted)
    line = F.filter(F.split(ex.report_text(), "\n"), lambda x: x.startswith(ex.ERROR_LINE.split("{")[0]))[0]
    return comparable(e.select("month", "predicted_sales", "actual_sales", line.alias("error_line")))


# --- SRC3, SRC5, SNK1-SNK6 --------------------------------------------------------------
@register("sales_csv_roundtrip", """
SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, CAST(sum(o_totalprice) AS FLOAT) AS sales
FROM orders GROUP BY 1""")
def sales_csv_roundtrip(spark, sf_dir):
    """SRC3: monthly sales as one CSV file, read by the folder reader."""
    path = scratch_path(spark, "sales-csv")
    monthly_sales(spark, sf_dir).coalesce(1).write.option("header", True).csv(path)      # one row per month
    return comparable(files.load_sales_csv(spark, path).drop("seq_no"))


def _daily_sales_csv(spark, sf_dir):
    """Daily sales as one CSV file, the last day first, read by the folder reader."""
    path = scratch_path(spark, "daily-sales-csv")
    (table(spark, sf_dir, "orders").where("o_orderdate is not null").groupBy(F.col("o_orderdate").cast("date").alias("date"))
     .agg(F.sum("o_totalprice").alias("sales")).coalesce(1).sortWithinPartitions(F.desc("date"))                          # one row per day
     .write.option("header", True).csv(path))
    return files.load_sales_csv(spark, path)


_DAILY = """
, daily AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS sales FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
fs AS (SELECT strftime(date, '%Y-%m') AS month, arg_max(sales, date) AS sales FROM daily GROUP BY 1)"""


@register("training_set_first_sale", wsql(_DAILY + """
SELECT fs.month, CAST(fs.sales AS FLOAT) AS sales, count(DISTINCT wl.word) AS n_words FROM fs JOIN wl ON wl.month = fs.month GROUP BY ALL"""))
def training_set_first_sale(spark, sf_dir):
    """SRC3 + J3: of a month's daily sales, the first row of the file counts."""
    t = wd.training_set(shared_word_lists(spark, sf_dir), _daily_sales_csv(spark, sf_dir))
    return comparable(t.select("month", "sales", F.size("words").cast("bigint").alias("n_words")))


@register("explain_first_sale", wsql(_DAILY + """
SELECT m.month, CAST(fs.sales AS FLOAT) AS actual_sales FROM (SELECT DISTINCT month FROM wl) m JOIN fs ON fs.month = m.month
WHERE fs.sales <> 0"""))
def explain_first_sale(spark, sf_dir):
    """SRC3 + J4: the same rule in the explanations."""
    words, sales = shared_word_lists(spark, sf_dir), materialise(_daily_sales_csv(spark, sf_dir), "daily-sales")
    e = ex.explanations(words, wd.correlation_scores(words, sales), sales)
    return comparable(e.select("month", "actual_sales"))


@register("importance_roundtrip", wsql("SELECT word, CAST(score AS FLOAT) AS score, CAST(raw_importance AS FLOAT) AS raw_importance, direction FROM imp"))
def importance_roundtrip(spark, sf_dir):
    """SNK4 + SRC5: word scores written and read again."""
    words, sales = shared_word_lists(spark, sf_dir), materialise(monthly_sales(spark, sf_dir), "month-sales")
    path = scratch_path(spark, "word-scores")
    sinks.write_word_scores(wd.correlation_scores(words, sales), path)
    return comparable(files.load_importance(spark, path))


@register("importance_object_roundtrip", wsql("SELECT word, CAST(score AS FLOAT) AS score, CAST(raw_importance AS FLOAT) AS raw_importance, direction FROM imp"))
def importance_object_roundtrip(spark, sf_dir):
    """SNK4 + SRC5 in the layout of one object."""
    words, sales = shared_word_lists(spark, sf_dir), materialise(monthly_sales(spark, sf_dir), "month-sales")
    path = scratch_path(spark, "word-scores-object")
    sinks.write_importance_object(wd.correlation_scores(words, sales), path)
    return comparable(files.load_importance(spark, path))


@register("period_table_roundtrip", pt_sql("""
SELECT period, order_count, CAST(total_sales AS FLOAT) AS total_sales, 'monthly' AS freq FROM pt"""))
def period_table_roundtrip(spark, sf_dir):
    """SNK1 + T1: the period table written by grain, twice, and read again."""
    path = scratch_path(spark, "period-table")
    p = periods(spark, sf_dir).select("period", "order_count", "total_sales")
    sinks.write_period_table(p.limit(1), path, "monthly")
    sinks.write_period_table(p, path, "monthly")              # replaces the grain's partition
    return comparable(spark.read.parquet(path))


@register("prediction_roundtrip", pt_sql("""
SELECT 'success' AS status, 'monthly' AS freq, max(period) AS last_period, CAST(arg_max(total_sales, period) AS FLOAT) AS last_value,
       count(*) AS n_samples FROM pt"""))
def prediction_roundtrip(spark, sf_dir):
    """SNK2: a prediction record written as JSON and read again."""
    r = periods(spark, sf_dir).agg(F.max("period").alias("p"), F.max_by("total_sales", "period").alias("v"), F.count(F.lit(1)).alias("n")).first()
    path = scratch_path(spark, "prediction")
    record = {"status": "success", "freq": "monthly", "last_period": r["p"], "last_value": float(r["v"]), "n_samples": r["n"]}
    sinks.write_prediction(spark, record, path, "0:00:01")
    got = spark.read.schema(sinks.prediction_frame(spark, record).schema).json(path)
    return comparable(got.select("status", "prediction.freq", "prediction.last_period", "prediction.last_value", "training.n_samples"))


@register("items_json_roundtrip", isql("SELECT keyword, url, seq_no, view_count, upload_date FROM items"))
def items_json_roundtrip(spark, sf_dir):
    """SNK6: items written as JSON and CSV; the JSON read again."""
    items = items_from_events(spark, sf_dir).select("keyword", "url", "seq_no", "view_count", "upload_date")
    path = scratch_path(spark, "items")
    sinks.write_items(items, f"{path}/json", f"{path}/csv")
    return spark.read.schema(items.schema).json(f"{path}/json")


# --- SRC2, SRC4: monthly word files -----------------------------------------------------
# Files that are not as they should be - a wrong score, a list, a broken file.
_ODD_FILES = [("1900-01", '{"rain": 0.5, "sun": "high", "wind": null}'), ("1900-02", '["rain", "sun", null]'), ("1900-03", '{"rain": 0.5')]


def _word_files(spark, sf_dir):
    path = scratch_path(spark, "word-files")
    texts = sinks.score_files(shared_word_scores(spark, sf_dir).select("month", "word", "score"))
    sinks.write_word_files(texts.unionByName(spark.createDataFrame(_ODD_FILES, "month string, value string")), path)
    return path


@register("word_score_files", wsql("""
SELECT month, word, CAST(score AS FLOAT) AS score, NULL AS wrong FROM wa WHERE month IS NOT NULL
UNION ALL SELECT * FROM (VALUES ('1900-01', 'rain', CAST(0.5 AS FLOAT), NULL), ('1900-01', 'sun', NULL, '"high"'), ('1900-01', 'wind', NULL, 'null'),
  ('1900-02', NULL, NULL, '["rain", "sun", null]'), ('1900-03', NULL, NULL, '{"rain": 0.5')) odd"""))
def word_score_files(spark, sf_dir):
    """SRC2: a JSON file of scores a month, written and read again, odd files beside them."""
    good, wrong = files.load_word_scores(spark, _word_files(spark, sf_dir))
    return comparable(good.withColumn("wrong", F.lit(None).cast("string"))
                      .unionByName(wrong.select("month", "word", F.lit(None).cast("double").alias("score"), F.trim("value", F.lit("\n")).alias("wrong"))))


@register("word_list_files", wsql("""
, o AS (SELECT month, word, row_number() OVER (PARTITION BY month ORDER BY word) AS pos FROM wa WHERE month IS NOT NULL)
SELECT month, word, CAST(pos AS INTEGER) AS pos, NULL AS wrong FROM o
UNION ALL SELECT * FROM (VALUES ('1900-01', 'rain', 1, NULL), ('1900-01', 'sun', 2, NULL), ('1900-01', 'wind', 3, NULL),
  ('1900-02', 'rain', 1, NULL), ('1900-02', 'sun', 2, NULL), ('1900-02', NULL, NULL, 'null'), ('1900-03', NULL, NULL, '{"rain": 0.5')) odd"""))
def word_list_files(spark, sf_dir):
    """SRC4: the words of the same files with their places."""
    good, wrong = files.load_word_lists(spark, _word_files(spark, sf_dir))
    return (good.select("month", "word", F.col("pos").cast("int").alias("pos"), F.lit(None).cast("string").alias("wrong"))
            .unionByName(wrong.select("month", "word", F.lit(None).cast("int").alias("pos"), F.trim("value", F.lit("\n")).alias("wrong"))))
