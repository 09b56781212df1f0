"""Collected text-item metadata (S1, S2, T6, T7, PF7, PF8, F9, F10, J6, J9, A14).

Skew: one keyword, month or URL may hold a third of all rows.  Dedupe is a
hash aggregate with ``min_by`` (map-side partial aggregation, so a hot URL
is reduced in every map task before the shuffle), and the top-N windows use
``row_number() <= N`` which Spark turns into a partial group limit ahead of
the exchange: a hot group ships at most N rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .indexing import split_rank
from .words import with_scalars

ITEM_COLUMNS = ["keyword", "title", "upload_date", "view_count", "description", "url", "source",
                "channel_title", "like_count", "comment_count", "duration"]


def dedupe_first(items: DataFrame, key: str = "url", order_col: str = "seq_no") -> DataFrame:
    """Keep the first row (lowest ``order_col``) of every ``key``."""
    cols = [c for c in items.columns if c != key]
    kept = items.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("r"))
    return kept.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def union_lists(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Collected lists as one; columns by name, missing ones NULL."""
    for other in more:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def dedupe_text(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """S2 on long texts: exact duplicates keep the lowest id.

    The shuffle key is (sha256, length) of the WHOLE text, so only 40 bytes
    per group cross the network instead of the text itself.
    """
    key = [F.sha2(F.col(text_col), 256).alias("h"), F.length(text_col).alias("len")]
    return (docs.groupBy(*key).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n_copies"))
            .select(id_col, "n_copies", "len"))


def year_month_cols(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts).cast("int"), "month": F.month(ts).cast("int")}


def top_n(items: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """``row_number() <= n`` per group (partial group limit before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def in_month(items: DataFrame, year: int, month: int, ts_col: str = "upload_ts") -> DataFrame:
    """PF8: items published in [first day of the month, first day of the next)."""
    from ..functions.calendar import month_range_filter
    return items.where(month_range_filter(F.col(ts_col), year, month))


def top_per_month(items: DataFrame, n: int = 10, ts_col: str = "upload_ts") -> DataFrame:
    """T6 + PF8: top n by views per keyword x year x month (ties: url, collection order)."""
    it = items.withColumns(year_month_cols(F.col(ts_col)))
    return top_n(it, ["keyword", "year", "month"], n,
                 [F.desc("view_count"), F.asc("url"), F.asc("seq_no")])


def year_filter_top(items: DataFrame, year: int | None = None) -> DataFrame:
    """T7 + PF7: the items with a non-empty ``yyyyMMdd`` date (of ``year``),
    ranked by views per keyword and year (ties: collection order).  The rank is
    found in many tasks, so one keyword may hold any share of the rows."""
    it = items.where((F.col("upload_date") != "") & F.col("upload_date").isNotNull())
    it = it.withColumn("year", F.substring("upload_date", 1, 4))
    if year is not None:
        it = it.where(F.col("upload_date").startswith(str(year)))
    return split_rank(it, ["keyword", "year"], [F.desc("view_count"), F.asc("seq_no")], "rank")


def iso_upload_date(raw: Column) -> Column:
    """'yyyyMMdd' -> 'yyyy-MM-ddTHH:mm:ss'; '' when missing or invalid (never raises)."""
    ts = F.try_to_timestamp(raw, F.lit("yyyyMMdd"))
    ok = F.length(raw) == 8
    return F.coalesce(F.when(ok, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


#: Fixed value: what a record without an address gets before its id.
URL_PREFIX = "https://www.youtube.com/watch?v="


def normalise_record(raw: DataFrame, url_prefix: str = URL_PREFIX, keep=()) -> DataFrame:
    """Python-``or`` defaults of a dumped record (id, webpage_url, uploader, channel, ...)."""
    return raw.select(
        *keep,
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        iso_upload_date(F.col("upload_date")).alias("upload_date"),
        F.coalesce(F.col("view_count").cast("bigint"), F.lit(0)).alias("view_count"),
        F.coalesce(blank_to_null(F.col("description")), F.lit("")).alias("description"),
        F.coalesce(blank_to_null(F.col("webpage_url")),
                   F.concat(F.lit(url_prefix), F.coalesce(F.col("id"), F.lit("")))).alias("url"),
        F.coalesce(blank_to_null(F.col("uploader")), blank_to_null(F.col("channel")), F.lit(""))
         .alias("channel_title"),
        F.when(F.col("duration").isNotNull() & (F.col("duration").cast("string") != "0"),
               F.col("duration").cast("string")).alias("duration"),
    )


def enrich_with_details(hits: DataFrame, details: DataFrame, key: str = "video_id") -> DataFrame:
    """Search hits ⟕ detail records; views default 0, the rest stay NULL."""
    d = details.select(key, F.col("view_count").alias("_v"), "like_count", "comment_count", "duration")
    return (hits.join(d, key, "left")
            .withColumn("view_count", F.coalesce(F.col("_v"), F.lit(0).cast("bigint"))).drop("_v"))


def coverage(items: DataFrame, ts_col: str = "upload_ts") -> DataFrame:
    """J9 + A14: keyword x month grid between the first and last month of the
    collection, with item and distinct-URL counts (0 for empty cells).

    Items are read once: their counts (a row per keyword and month) are
    written, and keywords and bound months come from there.  The grid is
    generated per keyword with ``sequence`` over the two bound months (a one-row
    aggregate) - no cross join.  Without any month the result is empty.
    """
    m = F.trunc(F.to_date(F.col(ts_col)), "MM")
    counts = materialise(items.groupBy("keyword", m.alias("month"))
                         .agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("url").alias("n_urls")), "item-cells")
    bounds = counts.agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    months = F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH")))
    grid = with_scalars(counts.select("keyword").distinct(), bounds).where("_lo is not null").select("keyword", months.alias("month"))
    return (grid.join(counts, ["keyword", "month"], "left")
            .select("keyword", F.date_format("month", "yyyy-MM").alias("month"),
                    F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                    F.coalesce("n_urls", F.lit(0)).cast("bigint").alias("n_urls")))


def collection_counts(items: DataFrame) -> DataFrame:
    """Rows collected and rows left after URL dedupe."""
    return items.agg(F.count(F.lit(1)).alias("n_collected"),
                     F.countDistinct("url").alias("n_unique"))
