"""Driver test tables and the frames the reference's inputs map onto.

The reference reads one order CSV, a folder of monthly word JSON files, a
monthly sales CSV and crawled video records.  On the TPC-H-like tables the
same roles are derived by Spark jobs (SURVEY §7.2), so every query's work
grows with the tables:

* ``order_facts``        orders ⟕ per-order (lineitem ⋈ part) ⟕ customer
* ``monthly_sales``      Σ o_totalprice per order month
* ``monthly_word_counts`` / ``monthly_word_lists``  tokens of p_name per month
* ``items_from_events``  events re-read as collected text items
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import period_group_key, period_label

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def order_facts(spark: SparkSession, sf_dir: str, category: bool = True, segment: bool = True) -> DataFrame:
    """One row per order with the reference's order-CSV column names.

    Two per-order aggregates of ``lineitem``, both grouped by the order key:

    * measures (quantity, first ship date, discount, return flag) are reduced
      per order with map-side partial aggregation - one shuffle of already
      reduced rows, hash-partitioned on the order key;
    * the category (min part type) needs the part join; only the narrow
      (orderkey, partkey) pairs are shuffled to meet ``part``.

    ``orders`` joins both on the order key (left: orders without lines keep
    NULL measures, as pandas NaN).  Those right sides are aggregates grouped by
    the join key, so Catalyst knows the key is unique and removes a left join
    whose columns a query does not use.  ``part`` and ``customer`` are joined
    as they are (their keys are unique): the exchanges of both sides
    stand right below the join, so AQE's skew join splits a hot part or
    customer.  ``category`` and ``segment`` say whether these two branches
    are wanted; the unwanted column is NULL.
    """
    lines = table(spark, sf_dir, "lineitem")
    measures = (lines.groupBy("l_orderkey")
                .agg(F.sum("l_quantity").alias("quantity"),
                     F.min("l_shipdate").alias("first_ship"),
                     F.avg("l_discount").alias("rating"),
                     F.min("l_returnflag").alias("sentiment")))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    by_order = (lines.select(F.col("l_orderkey").alias("c_orderkey"), "l_partkey")
                .join(parts, F.col("l_partkey") == parts.p_partkey, "left")
                .groupBy("c_orderkey").agg(F.min("p_type").alias("category")))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    facts = orders
    if segment:                                              # first: the order-key joins keep its exchange plain
        facts = facts.join(customers, orders.o_custkey == customers.c_custkey, "left")
    else:
        facts = facts.withColumn("c_mktsegment", F.lit(None).cast("string"))
    facts = facts.join(measures, orders.o_orderkey == measures.l_orderkey, "left")
    if category:
        facts = facts.join(by_order, orders.o_orderkey == by_order.c_orderkey, "left")
    else:
        facts = facts.withColumn("category", F.lit(None).cast("string"))
    return facts.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("order_total"),
        F.col("quantity"),
        F.col("o_custkey").alias("customer_id_x"),
        F.datediff(F.to_date("first_ship"), F.to_date("o_orderdate")).cast("double")
         .alias("delivery_time_minutes"),
        F.col("rating"),
        F.col("category"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.col("o_orderpriority").alias("delivery_status_x"),
        F.col("sentiment"),
        F.col("o_orderstatus").alias("payment_method"),
    )


def monthly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month date, sales double): the reference's monthly sales CSV."""
    orders = table(spark, sf_dir, "orders")
    return (orders.groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("month"))
            .agg(F.sum("o_totalprice").alias("sales")))


def monthly_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month 'yyyy-MM', word, n_lines): tokens of part names per order month.

    Lines are first reduced to (month, partkey) counts - at most months x parts
    rows - before the part join, so the wide lineitem side never meets part.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    # month key computed on orders (4x fewer rows than lines) as a cheap date
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", period_group_key("o_orderdate", "monthly").alias("m"))
    per_part = (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
                .groupBy("m", "l_partkey").agg(F.count(F.lit(1)).alias("n")))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    tokens = (per_part.join(parts, per_part.l_partkey == parts.p_partkey)
              .select("m", F.explode(F.split("p_name", " ")).alias("word"), "n")
              .where(F.col("word") != ""))
    return (tokens.groupBy("m", "word").agg(F.sum("n").alias("n_lines"))
            .select(period_label(F.col("m"), "monthly").alias("month"), "word", "n_lines"))


def monthly_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, word, pos, score, present) of every token of every month.

    ``score`` is the count over the month's largest count.  ``present`` says
    whether the token belongs to the month's word list: its share of the
    month's tokens is above its share of all months' tokens, compared exactly
    by cross-multiplication.  The (month, word) counts are written once; the
    windows after them hold one month's or one word's rows.
    """
    from ..operators.words import with_scalars
    from ..session import materialise
    counts = materialise(monthly_word_counts(spark, sf_dir), "word-counts")
    total = counts.agg(F.sum("n_lines").alias("n_all"))
    month, word = Window.partitionBy("month"), Window.partitionBy("word")
    ranked = counts.withColumns({
        "pos": F.row_number().over(month.orderBy(F.desc("n_lines"), F.asc("word"))),
        "score": F.col("n_lines") / F.max("n_lines").over(month),
        "n_month": F.sum("n_lines").over(month), "n_word": F.sum("n_lines").over(word)})

    def exact(c):
        return F.col(c).cast("decimal(19,0)")

    return with_scalars(ranked, total).select(
        "month", "word", "pos", "score",
        (exact("n_lines") * exact("n_all") > exact("n_word") * exact("n_month")).alias("present"))


def monthly_word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, word, pos, score): the tokens present in each month's list."""
    return monthly_word_scores(spark, sf_dir).where("present").drop("present")


def shared_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``monthly_word_scores`` written once to the shared checkpoint folder."""
    from ..session import materialise
    return materialise(monthly_word_scores(spark, sf_dir), "word-scores")


def shared_word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``monthly_word_lists`` written once to the shared checkpoint folder and
    re-read: jobs that read the lists several times (vocabulary, training
    months, per-word statistics, explanations) run the lineitem join once."""
    from ..session import materialise
    return materialise(monthly_word_lists(spark, sf_dir), "word-lists")


def items_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected text items (reference video-record schema) derived from ``events``.

    keyword = event_type, upload time = ts, views = props.k, url = user id,
    collection order = event_id.
    """
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("keyword"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"),
        F.date_format("ts", "yyyyMMdd").alias("upload_date"),
        F.col("ts").alias("upload_ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("view_count"),
        F.lit("").alias("description"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        F.lit("api").alias("source"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("channel_title"),
        F.col("value").cast("bigint").alias("like_count"),
        F.lit(None).cast("bigint").alias("comment_count"),
        F.lit(None).cast("string").alias("duration"),
        F.col("event_id").alias("seq_no"),
    )
