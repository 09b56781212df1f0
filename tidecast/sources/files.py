"""File sources of the reference's inputs (SRC1-SRC6).

All readers take explicit schemas (no inference), keep unreadable input in
a quarantine frame instead of failing the job, and prune by file name where
the reference selects files before opening them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.StringType()),
    T.StructField("order_total", T.DoubleType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("customer_id_x", T.StringType()),
    T.StructField("delivery_time_minutes", T.DoubleType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("customer_segment", T.StringType()),
    T.StructField("delivery_status_x", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("payment_method", T.StringType()),
])

RAW_ITEM_SCHEMA = T.StructType([
    T.StructField("keyword", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("upload_date", T.StringType()),
    T.StructField("view_count", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("webpage_url", T.StringType()),
    T.StructField("uploader", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("duration", T.StringType()),
])

def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths matching a glob on any Hadoop file system (metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    statuses = fs.globStatus(path)
    if statuses is None:
        return []
    return sorted(str(s.getPath().toString()) for s in statuses if s.isFile())


# --- SRC1 ---------------------------------------------------------------------
def load_orders_csv(spark: SparkSession, path: str, schema: T.StructType = ORDER_SCHEMA) -> DataFrame:
    """Order CSV -> typed frame with ``order_date`` as timestamp and ``year_month``.

    Columns are found by their names in the header, in any order; other
    columns are left out and never parsed.  A missing column raises, and so does an unparsable
    date under ANSI mode, as ``pd.to_datetime`` does.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header")
    typed = raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    ts = F.to_timestamp_ntz("order_date")   # naive, like pd.to_datetime; no session-zone shift
    return typed.withColumns({"order_date": ts, "year_month": F.date_format(ts, "yyyy-MM")})


def order_summary(orders: DataFrame) -> DataFrame:
    """Row count and date range reported after loading."""
    return orders.agg(F.count(F.lit(1)).alias("n_orders"), F.min("order_date").alias("first_date"),
                      F.max("order_date").alias("last_date"))


# --- SRC2 ---------------------------------------------------------------------
def _whole_files(spark: SparkSession, directory: str, month: str | None) -> DataFrame:
    # ``wholetext`` must be the argument of text(): as an option it is overridden.
    pattern = f"{directory.rstrip('/')}/{month if month else '*'}.json"
    if not list_files(spark, pattern):
        return spark.createDataFrame([], "month string, value string")
    df = spark.read.text(pattern, wholetext=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("month"),
                     "value")


def _first_mark(value: Column) -> Column:
    return F.substring(F.ltrim(value, F.lit(" \t\r\n")), 1, 1)


def _entries(spark: SparkSession, files: DataFrame) -> DataFrame:
    """A row per member of every file's object or array: month, key (objects), pos (arrays, from 0), entry (variant)."""
    parsed = files.select("month", F.try_parse_json("value").alias("v"))
    return parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("month", "key", "pos", F.col("value").alias("entry"))


def _is_number(entry: Column) -> Column:
    kind = F.schema_of_variant(entry)
    return kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")


def load_word_scores(spark: SparkSession, directory: str, month: str | None = None):
    """Monthly ``{word: score}`` files -> ((month, word, score), quarantine (month, word, value)).

    The month filter selects the file by name before it is read (the
    reference's file-level pruning).  A score that is no number (text, truth value, null, list, object) goes to the quarantine
    alone, under its word; a file that is no JSON object, or names a word twice,
    goes there whole, with a NULL word.
    """
    files = _whole_files(spark, directory, month)
    is_object = (_first_mark(F.col("value")) == "{") & F.try_parse_json("value").isNotNull()
    scores = _entries(spark, files.where(is_object))
    good = scores.where(_is_number(F.col("entry"))).select("month", F.col("key").alias("word"), F.try_variant_get("entry", "$", "double").alias("score"))
    wrong = scores.where(~_is_number(F.col("entry"))).select("month", F.col("key").alias("word"), F.to_json("entry").alias("value"))
    whole = files.where(~F.coalesce(is_object, F.lit(False))).select("month", F.lit(None).cast("string").alias("word"), "value")
    return good, wrong.unionByName(whole)


def place_in_file() -> Column:
    """Text that sorts rows of files by file name, then as they stand in the file."""
    return F.concat_ws(":", "_metadata.file_name", F.lpad(F.col("_metadata.file_block_start").cast("string"), 15, "0"),
                       F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0"))


# --- SRC3 ---------------------------------------------------------------------
def load_sales_csv(spark: SparkSession, directory: str) -> DataFrame:
    """First (lexicographic) ``*.csv`` of the folder -> (month date, sales double, seq_no).

    ``month`` is parsed; otherwise ``date`` is floored to its month start
    (not aggregated); ``seq_no`` orders rows as they stand in the file, however Spark splits
    it.  No file -> empty frame with the same schema.
    """
    files = list_files(spark, f"{directory.rstrip('/')}/*.csv")
    if not files:
        return spark.createDataFrame([], "month date, sales double, seq_no string")
    raw = spark.read.option("header", True).csv(files[0])
    cols = set(raw.columns)
    if "month" in cols:
        month = F.to_date(F.to_timestamp("month"))
    elif "date" in cols:
        month = F.trunc(F.to_date(F.to_timestamp("date")), "MM")
    else:
        raise ValueError("sales file needs a 'month' or 'date' column")
    return raw.select(month.alias("month"), F.col("sales").cast("double").alias("sales"), place_in_file().alias("seq_no"))


# --- SRC4 ---------------------------------------------------------------------
def load_word_lists(spark: SparkSession, directory: str):
    """Monthly word files holding a list, or an object (its keys are the words, whatever the values).

    -> ((month, word, pos), quarantine (month, word, value)); ``pos`` counts from 1 in file order.  Members of a list that
    are no words (null, list, object) go to the quarantine alone, with a NULL word, as
    files do that are neither list nor object; numbers and truth values are words as they are written.
    """
    files = _whole_files(spark, directory, None)
    keys = F.when(_first_mark(F.col("value")) == "{", F.json_object_keys("value"))
    is_list = (_first_mark(F.col("value")) == "[") & F.try_parse_json("value").isNotNull()
    named = files.withColumn("w", keys).where("w is not null").select("month", F.posexplode("w").alias("pos", "word"))
    members = _entries(spark, files.where(is_list))
    kind = F.schema_of_variant("entry")
    is_word = ~(kind.startswith("VOID") | kind.startswith("ARRAY") | kind.startswith("OBJECT"))
    listed = members.where(is_word).select("month", "pos", F.try_variant_get("entry", "$", "string").alias("word"))
    good = named.unionByName(listed).select("month", (F.col("pos") + 1).alias("pos"), "word")
    no_word = F.lit(None).cast("string").alias("word")
    wrong = members.where(~is_word).select("month", no_word, F.to_json("entry").alias("value"))
    whole = files.where(keys.isNull() & ~F.coalesce(is_list, F.lit(False))).select("month", no_word, "value")
    return good, wrong.unionByName(whole)


# --- SRC5 ---------------------------------------------------------------------
IMPORTANCE_SCHEMA = "word string, score double, raw_importance double, direction string"
IMPORTANCE_OBJECT_SCHEMA = ("word_scores map<string,double>, "
                            "feature_importance map<string,struct<score:double,raw_importance:double,direction:string>>")


def load_importance(spark: SparkSession, path: str) -> DataFrame:
    """Saved word importance, in either layout: one record a line (``sinks.write_word_scores``), or one
    object with ``word_scores`` and ``feature_importance`` (``sinks.write_importance_object``).
    A file in neither layout raises; an empty folder gives an empty frame."""
    lines = spark.read.schema(IMPORTANCE_SCHEMA).json(path)
    if not lines.where("word is not null").isEmpty():
        return lines
    objects = spark.read.option("multiLine", True).schema(IMPORTANCE_OBJECT_SCHEMA).json(path)
    if not objects.where("feature_importance is not null").isEmpty():
        return objects.select(F.explode("feature_importance").alias("word", "i")).select(
            "word", "i.score", "i.raw_importance", "i.direction")
    if not spark.read.text(path).where("trim(value) <> ''").isEmpty():
        raise ValueError(f"{path}: neither records of words nor an object with feature_importance")
    return lines


# --- SRC6 ---------------------------------------------------------------------
def load_item_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Line-JSON item dump -> (records, quarantine).

    ``seq_no`` orders records as they stand in the dump, files by name,
    however Spark splits or packs the files.

    Fields are read as text and counts converted leniently (``7``, ``"7"`` and
    ``7.0`` are 7; anything else is NULL).  Lines that are no JSON object go
    to the quarantine frame (file, line); blank lines are skipped.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in RAW_ITEM_SCHEMA])
    lines = (spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), place_in_file().alias("seq_no"), F.trim("value").alias("line"))
             .where("line <> ''").withColumn("r", F.from_json("line", text, {"mode": "PERMISSIVE"}))
             .withColumn("ok", F.col("line").startswith("{") & F.try_parse_json("line").isNotNull()))
    counts = {f.name for f in RAW_ITEM_SCHEMA if isinstance(f.dataType, T.LongType)}
    good = lines.where("ok").select("seq_no", *[
        (F.floor(F.col(f"r.{f.name}").try_cast("double")).cast("bigint") if f.name in counts else F.col(f"r.{f.name}")).alias(f.name)
        for f in RAW_ITEM_SCHEMA])
    return good, lines.where("not ok").select("file", "line")
