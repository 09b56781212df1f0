"""Monthly words joined with sales.

Word data stays LONG - (month, word[, score]) - so nothing grows with
months x vocabulary unless a wide matrix is asked for explicitly, and the
correlation score (M10) is computed from per-word sufficient statistics
with one ``groupBy(word)``: sparse, partial-aggregated, skew-safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indexing import dense_index

MAX_WIDE_WORDS = 10_000


def vocabulary(words: DataFrame) -> DataFrame:
    """A10: (word, idx) over all months, alphabetical, 0-based."""
    return dense_index(words.select("word"), "word", "idx")


def multi_hot_long(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """M1 in long form: (month, word, idx) for words known to the vocabulary."""
    return words.select("month", "word").distinct().join(vocab, "word")


def multi_hot_vectors(words: DataFrame, vocab_words: list[str]) -> DataFrame:
    """M1 as ML vectors: (month, features) with a binary CountVectorizer over
    the given ALPHABETICAL vocabulary (the default fit orders by frequency)."""
    from pyspark.ml.feature import CountVectorizerModel
    lists = words.groupBy("month").agg(F.collect_set("word").alias("words"))
    cv = CountVectorizerModel.from_vocabulary(sorted(vocab_words), inputCol="words",
                                              outputCol="features", binary=True)
    return cv.transform(lists).select("month", "features")


def coverage_info(words: DataFrame, sales: DataFrame) -> DataFrame:
    """Sorted distinct months of both inputs and their counts (the sales
    count is a row count, as in the reference)."""
    w = words.agg(F.array_sort(F.collect_set("month")).alias("input_data_months"))
    s = sales_month_key(sales).agg(F.array_sort(F.collect_set("month_str")).alias("sales_data_months"),
                                   F.count(F.lit(1)).alias("total_sales_months"))
    return (w.withColumn("_one", F.lit(1)).join(F.broadcast(s.withColumn("_one", F.lit(1))), "_one")
            .drop("_one").withColumn("total_input_months", F.size("input_data_months").cast("bigint")))


def sales_month_key(sales: DataFrame) -> DataFrame:
    """Sales with the 'yyyy-MM' month string used by the word data."""
    return sales.withColumn("month_str", F.date_format("month", "yyyy-MM"))


def word_score_matrix(sales: DataFrame, scores: DataFrame,
                      max_words: int = MAX_WIDE_WORDS) -> DataFrame:
    """Sales ⟕ wide word scores on the month string; missing -> 0.0.

    Every word of every month becomes a column (also words of months without
    a sale), named ``word_score_<word>``.  The pivot values are fetched in one
    bounded job; beyond ``max_words`` the caller must stay long.
    """
    vals = [r["word"] for r in scores.select("word").distinct().orderBy("word")
            .limit(max_words + 1).collect()]
    if len(vals) > max_words:
        raise ValueError(f"more than {max_words} words; keep the score data long")
    wide = (scores.groupBy(F.col("month").alias("month_str")).pivot("word", vals)
            .agg(F.first("score")))
    wide = wide.select("month_str", *[F.col(f"`{v}`").alias(f"word_score_{v}") for v in vals])
    out = sales_month_key(sales).join(wide, "month_str", "left")
    return out.na.fill(0.0, [f"word_score_{v}" for v in vals]).drop("month_str")


def word_feature_vectors(matrix: DataFrame, prefix: str = "word_score_") -> DataFrame:
    """M2: the ``word_score_*`` columns of a score matrix as one ML vector per
    row (columns by name, so the order matches the sorted vocabulary)."""
    from pyspark.ml.feature import VectorAssembler
    cols = sorted(c for c in matrix.columns if c.startswith(prefix))
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(matrix)


def first_sales(sales: DataFrame) -> DataFrame:
    """(month_str, sales): a month's first row by ``seq_no`` (its place in the file); sales
    without that column go by (month, sales).  An aggregate, not a window."""
    first = "seq_no" if "seq_no" in sales.columns else F.struct("month", "sales")
    return sales_month_key(sales).groupBy("month_str").agg(F.min_by("sales", first).alias("sales"))


def training_set(words: DataFrame, sales: DataFrame) -> DataFrame:
    """Months present in both inputs, with the month's first sale."""
    first_sale = first_sales(sales)
    wl = words.groupBy("month").agg(F.array_sort(F.collect_set("word")).alias("words"))
    return wl.join(first_sale.withColumnRenamed("month_str", "month"), "month")


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a ONE-row global aggregate to every row.

    ``scalars`` is a global aggregate, so its size is proven (one row); it is
    broadcast (Spark plans a nested loop over that one row): no shuffle of ``df`` and
    no driver round trip that would re-run the upstream plan.
    """
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(scalars.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def correlation_scores(words: DataFrame, sales: DataFrame) -> DataFrame:
    """M10 + A12 + F5: Pearson correlation of word presence with sales.

    Over the training months T (months with words and a sale), a word w
    present in T_w has  p = |T_w|/n,  cov = Σ_{T_w}(y - ȳ)/n,  var_x = p(1-p),
    so only the (month, word) pairs that exist are touched - no
    months x vocabulary grid - with one ``groupBy(word)``.
    """
    train = training_set(words, sales).select("month", "sales")
    tot = train.agg(F.count(F.lit(1)).alias("_n"), F.avg("sales").alias("_mean"),
                    F.var_pop("sales").alias("_var_y"))
    per_word = (words.select("month", "word").distinct().join(train, "month")
                .groupBy("word")
                .agg(F.count(F.lit(1)).alias("n_w"), F.sum("sales").alias("s_w")))
    # words never present in a training month still belong to the vocabulary (score 0)
    all_words = words.select("word").distinct().join(per_word, "word", "left")
    x = with_scalars(all_words, tot)
    p = F.col("n_w") / F.col("_n")
    cov = (F.col("s_w") - F.col("n_w") * F.col("_mean")) / F.col("_n")
    var_x = p * (F.lit(1.0) - p)
    raw = F.when((var_x > 0) & (F.col("_var_y") > 0), cov / F.sqrt(var_x * F.col("_var_y")))
    scored = x.select("word", F.coalesce(raw, F.lit(0.0)).alias("raw_importance"))
    return normalise_importance(scored)


def normalise_importance(df: DataFrame, raw: str = "raw_importance") -> DataFrame:
    """A12 + F5: score = |raw| / max|raw| (unchanged if the max is 0); direction by sign."""
    mx = df.agg(F.max(F.abs(F.col(raw))).alias("_mx"))
    x = with_scalars(df, mx)
    score = F.when(F.col("_mx") > 0, F.abs(F.col(raw)) / F.col("_mx")).otherwise(F.abs(F.col(raw)))
    return x.select("word", score.alias("score"), F.col(raw).alias("raw_importance"),
                    F.when(F.col(raw) > 0, F.lit("positive")).otherwise(F.lit("negative"))
                    .alias("direction"))


def top_words(importance: DataFrame, n: int = 10, direction: str = "all") -> DataFrame:
    """T2 + T3: top n by score desc, ties alphabetical; unknown direction = all."""
    df = importance
    if direction in ("positive", "negative"):
        df = df.where(F.col("direction") == direction)
    w = Window.orderBy(F.desc("score"), F.asc("word"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_words_all_directions(importance: DataFrame, n: int = 10) -> DataFrame:
    """T3 for all / positive / negative at once: one window partitioned by direction
    (the row_number <= n filter becomes a partial group limit before the shuffle)."""
    tagged = importance.select("*", F.explode(F.array(F.lit("all"), F.col("direction"))).alias("dir"))
    w = Window.partitionBy("dir").orderBy(F.desc("score"), F.asc("word"))
    return (tagged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(F.col("dir").alias("direction_filter"), "rank", "word", "score", "direction"))


def next_month_vector(scores: DataFrame, sales: DataFrame, as_of_month: str | None = None) -> DataFrame:
    """J7 + PF14: next month's score of every vocabulary word (0 when absent); no row without any sale.

    The next month is the month after the last sale (or ``as_of_month``);
    when no word file exists for it, the last month with words is used.
    """
    last = F.lit(as_of_month) if as_of_month else F.max("month_str")
    following = F.date_format(F.add_months(F.to_date(F.concat("_last", F.lit("-01"))), 1), "yyyy-MM")
    target = sales_month_key(sales).agg(last.alias("_last")).select(following.alias("target_month"))
    months = with_scalars(scores.select("month").distinct(), target)
    same = F.col("month") == F.col("target_month")
    chosen = months.agg(F.max("target_month").alias("target_month"),
                        F.coalesce(F.max(F.when(same, F.col("month"))), F.max("month")).alias("source_month"))
    of_month = F.max(F.when(F.col("month") == F.col("source_month"), F.col("score")))
    return (with_scalars(scores, chosen).where("target_month is not null")
            .groupBy("target_month", "source_month", "word").agg(F.coalesce(of_month, F.lit(0.0)).alias("score")))
