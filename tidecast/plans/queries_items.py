"""Registered queries: collected text items (dedupe, top-N, formatting, coverage)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import item_store as store
from ..operators import items as it
from ..session import scratch_path
from ..sources.tables import items_from_events, table
from .registry import comparable, register

ITEMS_CTE = """
items AS (SELECT event_type AS keyword, event_type || ' ' || CAST(event_id AS VARCHAR) AS title,
                 strftime(ts, '%Y%m%d') AS upload_date, ts AS upload_ts,
                 CAST(json_extract_string(props, '$.k') AS BIGINT) AS view_count, '' AS description,
                 'u' || CAST(user_id AS VARCHAR) AS url, 'api' AS source,
                 'user ' || CAST(user_id AS VARCHAR) AS channel_title,
                 CAST(trunc(value) AS BIGINT) AS like_count, CAST(NULL AS BIGINT) AS comment_count,
                 CAST(NULL AS VARCHAR) AS duration, event_id AS seq_no
          FROM events)"""


def isql(body: str) -> str:
    return f"WITH {ITEMS_CTE}\n{body}"


@register("items_dedupe_url", isql("""
SELECT * EXCLUDE (rn, upload_ts) FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq_no) AS rn FROM items) x WHERE rn = 1"""))
def items_dedupe_url(spark, sf_dir):
    """First item of every URL in collection order."""
    return comparable(it.dedupe_first(items_from_events(spark, sf_dir).drop("upload_ts")))


@register("items_upsert", isql("""
SELECT * EXCLUDE (rn, upload_ts) FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq_no) AS rn FROM items) x WHERE rn = 1"""))
def items_upsert(spark, sf_dir):
    """S2 with arriving dumps: three batches, the latest items first, merged into a table kept by URL."""
    arriving, path = items_from_events(spark, sf_dir).drop("upload_ts"), scratch_path(spark, "item-store")
    for part in (2, 0, 1):
        store.upsert(arriving.where(F.pmod(F.xxhash64("seq_no"), F.lit(3)) == part), path, n_buckets=8)
    return comparable(store.items(spark, path))


@register("items_top_n_month", isql("""
SELECT keyword, year, month, CAST(rank AS INTEGER) AS rank, url, view_count, seq_no FROM (
  SELECT keyword, CAST(year(upload_ts) AS INTEGER) AS year, CAST(month(upload_ts) AS INTEGER) AS month,
         url, view_count, seq_no,
         row_number() OVER (PARTITION BY keyword, year(upload_ts), month(upload_ts)
                            ORDER BY view_count DESC, url, seq_no) AS rank
  FROM items) x WHERE rank <= 10"""))
def items_top_n_month(spark, sf_dir):
    """T6 + PF8: top 10 by views per keyword x year x month."""
    top = it.top_per_month(items_from_events(spark, sf_dir), 10)
    return comparable(top.select("keyword", "year", "month", "rank", "url", "view_count", "seq_no"))


@register("items_year_filter", isql("""

SELECT keyword, substr(upload_date, 1, 4) AS year,
       CAST(row_number() OVER (PARTITION BY keyword, substr(upload_date, 1, 4) ORDER BY view_count DESC, seq_no)
            AS INTEGER) AS rank, url, view_count, seq_no, upload_date
FROM items WHERE upload_date <> '' AND upload_date IS NOT NULL AND starts_with(upload_date, '2024')"""))
def items_year_filter(spark, sf_dir):
    """T7 + PF7: all items of 2024, ranked by views per keyword."""
    top = it.year_filter_top(items_from_events(spark, sf_dir), 2024)
    return comparable(top.select("keyword", "year", "rank", "url", "view_count", "seq_no", "upload_date"))


_ISO = "coalesce(CASE WHEN length({x}) = 8 THEN strftime(try_strptime({x}, '%Y%m%d'), '%Y-%m-%dT%H:%M:%S') END, '')"


@register("items_date_format", isql(f"""
SELECT seq_no, upload_date, {_ISO.format(x='upload_date')} AS upload_iso,
       {_ISO.format(x="substr(upload_date, 1, 6) || '99'")} AS bad_iso,
       {_ISO.format(x="substr(upload_date, 1, 6)")} AS short_iso
FROM items"""))
def items_date_format(spark, sf_dir):
    """F9 on valid, invalid (day 99) and truncated date strings: never raises."""
    items = items_from_events(spark, sf_dir)
    raw = F.col("upload_date")
    return comparable(items.select(
        "seq_no", "upload_date", it.iso_upload_date(raw).alias("upload_iso"),
        it.iso_upload_date(F.concat(F.substring(raw, 1, 6), F.lit("99"))).alias("bad_iso"),
        it.iso_upload_date(F.substring(raw, 1, 6)).alias("short_iso")))


def raw_records(spark, sf_dir):
    """Dumped search records derived from events, with the blanks and NULLs the
    reference's ``or`` defaults exist for."""
    ev = table(spark, sf_dir, "events")
    uid = F.col("user_id").cast("string")
    return ev.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("title"),
        F.date_format("ts", "yyyyMMdd").alias("upload_date"),
        F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("bigint"))
         .alias("view_count"),
        F.when(F.col("event_type") != "signup", F.lit("d")).alias("description"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("u"), uid)).otherwise(F.lit(""))
         .alias("webpage_url"),
        F.when(F.col("event_type") != "click", F.concat(F.lit("user "), uid)).otherwise(F.lit(""))
         .alias("uploader"),
        F.concat(F.lit("ch"), uid).alias("channel"),
        F.when(F.col("event_type") != "purchase", F.col("value").cast("bigint")).alias("duration"),
    )


@register("items_normalise", f"""
WITH r AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_type AS title, strftime(ts, '%Y%m%d') AS upload_date,
         CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS view_count,
         CASE WHEN event_type <> 'signup' THEN 'd' END AS description,
         CASE WHEN event_type <> 'error' THEN 'u' || CAST(user_id AS VARCHAR) ELSE '' END AS webpage_url,
         CASE WHEN event_type <> 'click' THEN 'user ' || CAST(user_id AS VARCHAR) ELSE '' END AS uploader,
         'ch' || CAST(user_id AS VARCHAR) AS channel,
         CASE WHEN event_type <> 'purchase' THEN CAST(trunc(value) AS BIGINT) END AS duration
  FROM events)
SELECT id, coalesce(title, '') AS title, {_ISO.format(x='upload_date')} AS upload_date,
       coalesce(view_count, 0) AS view_count, coalesce(NULLIF(description, ''), '') AS description,
       coalesce(NULLIF(webpage_url, ''), 'https://www.youtube.com/watch?v=' || coalesce(id, '')) AS url,
       coalesce(NULLIF(uploader, ''), NULLIF(channel, ''), '') AS channel_title,
       CASE WHEN duration IS NOT NULL AND CAST(duration AS VARCHAR) <> '0' THEN CAST(duration AS VARCHAR) END AS duration
FROM r""")
def items_normalise(spark, sf_dir):
    """F10 (+ F9): the Python-``or`` defaults of a dumped record."""
    raw = raw_records(spark, sf_dir)
    return comparable(it.normalise_record(raw, keep=["id"]))


@register("items_enrich", """
WITH hits AS (SELECT event_id, event_type AS keyword, user_id AS video_id FROM events),
det AS (SELECT user_id AS video_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS view_count,
               count(*) AS like_count, CAST(NULL AS BIGINT) AS comment_count,
               CAST(max(trunc(value)) AS BIGINT) AS duration
        FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT h.event_id, h.keyword, h.video_id, coalesce(d.view_count, 0) AS view_count,
       d.like_count, d.comment_count, CAST(d.duration AS VARCHAR) AS duration
FROM hits h LEFT JOIN det d USING (video_id)""")
def items_enrich(spark, sf_dir):
    """All events as hits ⟕ per-video details; a video has details once it was purchased."""
    ev = table(spark, sf_dir, "events")
    hits = ev.select(
        "event_id", F.col("event_type").alias("keyword"), F.col("user_id").alias("video_id"))
    det = (ev.where(F.col("event_type") == "purchase").groupBy(F.col("user_id").alias("video_id"))
           .agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("view_count"),
                F.count(F.lit(1)).alias("like_count"),
                F.lit(None).cast("bigint").alias("comment_count"),
                F.max(F.col("value").cast("bigint")).cast("string").alias("duration")))
    return comparable(it.enrich_with_details(hits, det))


@register("collection_coverage", isql("""
, b AS (SELECT min(date_trunc('month', upload_ts)) AS lo, max(date_trunc('month', upload_ts)) AS hi FROM items),
grid AS (SELECT k.keyword, CAST(g.m AS DATE) AS month
         FROM (SELECT DISTINCT keyword FROM items) k, b, generate_series(b.lo, b.hi, INTERVAL 1 MONTH) g(m)),
c AS (SELECT keyword, CAST(date_trunc('month', upload_ts) AS DATE) AS month, count(*) AS n_items,
             count(DISTINCT url) AS n_urls FROM items GROUP BY 1, 2)
SELECT grid.keyword, strftime(grid.month, '%Y-%m') AS month, coalesce(c.n_items, 0) AS n_items,
       coalesce(c.n_urls, 0) AS n_urls
FROM grid LEFT JOIN c USING (keyword, month)"""))
def collection_coverage(spark, sf_dir):
    """J9 + S1 + A14: keyword x month grid with item counts (no cross join)."""
    return it.coverage(items_from_events(spark, sf_dir))


@register("collection_counts", isql("SELECT count(*) AS n_collected, count(DISTINCT url) AS n_unique FROM items"))
def collection_counts(spark, sf_dir):
    """Rows collected vs rows left after URL dedupe."""
    return it.collection_counts(items_from_events(spark, sf_dir))


@register("documents_dedupe", """
SELECT min(doc_id) AS doc_id, count(*) AS n_copies, CAST(length(text) AS INTEGER) AS len
FROM documents GROUP BY text""")
def documents_dedupe(spark, sf_dir):
    """S2 on whole document texts: exact copies keep the lowest doc_id."""
    return it.dedupe_text(table(spark, sf_dir, "documents"))
