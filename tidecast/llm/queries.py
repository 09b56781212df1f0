"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, rule_ensemble, toxicity, wordpiece_counts
from .common import fold, table
from .exact_dedup import exact_duplicates
from .jaccard_join import jaccard_components
from .license_scan import COPYRIGHT_STATEMENT, RIGHTS_RESERVED, SPELLINGS, known_licenses, known_texts, scan_licenses
from .multiprobe import nearest_neighbours
from .packing import pack
from .periodic_runs import periodic_runs
from .prefix_trie import prefix_trie, turn_digests
from .spaced_seeds import MASKS, REACH, RUN, SHARE, decontaminate
from .url_rules import apply_url_rules

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return keep


@query("op6_exact_dedup", """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal up to A-Z case; the largest doc_id of a group stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


#: The url rules (host, path, action).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op8_url_rules", """
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                       ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
                           THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT p.*, (SELECT max_by({'rule': r.host || r.path, 'verdict': r.verdict},
                                 length(r.host) * 10000 + length(r.path))
                   FROM r WHERE (p.host = r.host OR p.host LIKE '%.' || r.host)
                            AND starts_with(p.path, r.path)) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM k
""")
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return apply_url_rules(table(spark, sf_dir, "pages"), rules)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(c: str) -> str:
    c = f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    c = f"regexp_replace({c}, {_sql_text(COPYRIGHT_STATEMENT)}, '\\1')"
    c = f"regexp_replace({c}, {_sql_text(RIGHTS_RESERVED)}, ' ', 'g')"
    return _spelled_sql(f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))")


def _spelled_sql(c: str) -> str:
    for spelling, one in SPELLINGS:
        c = f"replace({c}, {_sql_text(spelling)}, {_sql_text(one)})"
    return c


@query("op10_license_scan", f"""
WITH k AS (SELECT DISTINCT license, sha256({_canonical_sql('text')}) AS digest
           FROM (VALUES {', '.join(f'({_sql_text(a)}, {_sql_text(b)})' for a, b in known_texts())}) v(license, text)),
l AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'),
                            lambda x: {_canonical_sql('x')})) AS c,
             generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), 1) AS line_no
      FROM documents),
b AS (SELECT *, sum((c = '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS blanks FROM l),
u AS (SELECT doc_id, 'line' AS unit, line_no, c FROM l WHERE c <> ''
      UNION ALL
      SELECT doc_id, 'document', 0, {_spelled_sql("string_agg(c, ' ' ORDER BY line_no)")} FROM l WHERE c <> '' GROUP BY doc_id
      UNION ALL
      SELECT doc_id, 'paragraph', min(line_no), {_spelled_sql("string_agg(c, ' ' ORDER BY line_no)")} FROM b WHERE c <> '' GROUP BY doc_id, blanks HAVING count(*) > 1)
SELECT doc_id, unit, line_no::INTEGER AS line_no, license,
       k.digest AS digest
FROM u JOIN k ON sha256(u.c) = k.digest
""")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_licenses(spark))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, size=4096)


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = language_id.fit(docs, fold(F.col("doc_id"), 4) != 2)
    return (language_id.identify(docs, training)
            .select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = wordpiece_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    return wordpiece_counts.count_tokens(table(spark, sf_dir, "documents"), pieces)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op9_rule_ensemble")
def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return rule_ensemble.score(docs, rules).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def _seeds_sql(source: str, keep: str) -> str:
    span = max(map(len, MASKS))
    keys = ", ".join("[%s]" % ", ".join(f"w[p + {k}]" for k, c in enumerate(m) if c == "1") for m in MASKS)
    return (f"SELECT {keep}, p - 1 AS pos, unnest([{keys}]) AS key, unnest(range({len(MASKS)})) AS mask FROM "
            f"(SELECT {keep}, w, unnest(range(1, len(w) - {span} + 2)) AS p FROM {source} WHERE len(w) >= {span})")


@query("op7_decontaminate", fr"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
           FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
      FROM benchmark),
ds AS ({_seeds_sql('d', 'doc_id')}),
bs AS ({_seeds_sql('b', 'item_id')}),
h AS (SELECT ds.doc_id, bs.item_id, ds.pos AS word, bs.pos AS item_word FROM ds JOIN bs ON ds.key = bs.key AND ds.mask = bs.mask),
c AS (SELECT h.doc_id, h.item_id, h.word, greatest(h.item_word - {REACH}, 0) AS f,
             least(h.item_word + {max(map(len, MASKS)) + REACH}, len(b.w)) AS l, h.word - h.item_word AS s, d.w AS dw, b.w AS bw
      FROM h JOIN d ON h.doc_id = d.doc_id JOIN b ON h.item_id = b.item_id),
e AS (SELECT doc_id, item_id, word, list_transform(range(f, l), lambda k: CASE WHEN k + s >= 0 AND dw[(k + s + 1)::BIGINT] = bw[(k + 1)::BIGINT]
                                                                              THEN '1' ELSE '0' END) AS same FROM c),
v AS (SELECT doc_id, item_id, word, len(same) AS compared, len(list_filter(same, lambda k: k = '1')) AS equal, array_to_string(same, '') AS marks FROM e)
SELECT doc_id, item_id, min(word)::BIGINT AS first_word, count(*) AS n_hits, max(equal)::BIGINT AS n_equal
FROM v WHERE equal >= {SHARE} * compared OR contains(marks, '{'1' * RUN}') GROUP BY ALL
""")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), threshold_percent=90)


@query("op12_nearest_neighbours")
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """The query's input: of every id with crc32(id) % 10 = 0, the words from one place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    split = (docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
             .withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(n > 0, F.col("g") % n))
             .withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), a), again), F.lit(1), n.cast("int")), " ")
    return split.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(_with_planted_periods(docs), least=12)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("top", F.when(F.size("runs") > 0, longest))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.l")).alias("length"),
                    F.col("top.period").alias("period"), F.floor(F.lit(1000) * -F.col("top.l") / F.col("top.period")).cast("long").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


#: CRC-32 of a decimal number's characters, bit by bit (DuckDB has no such function).
def _crc32_sql(c: str) -> str:
    step = "list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    bytes_ = f"list_transform(string_split({c}::VARCHAR, ''), lambda k: ascii(k)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda r, b: {step}), 4294967295)"


@query("op11_prefix_trie", f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':'
                                     || coalesce(role, '') || coalesce(text, ''))) AS place
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32_sql('conv_id')} % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
m AS (SELECT c.*, (SELECT count(*) FROM t WHERE t.conv_id = c.base AND t.place <= c.h) AS n_head FROM c),
r AS (SELECT c.conv_id, t.place AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
      UNION ALL
      SELECT m.conv_id, place - h + n_head, role, text FROM m JOIN t ON t.conv_id = m.conv_id AND place > h),
e AS (SELECT conv_id, depth, strlen(text) AS n_bytes,
             string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key
      FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
x AS (SELECT *, md5(key) AS node, lag(md5(key)) OVER w AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS last
      FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
             sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
      FROM x GROUP BY node, depth),
k AS (SELECT n.*, (SELECT count(*) FROM n AS o WHERE o.up = n.node AND o.depth = n.depth + 1) AS n_children FROM n),
s AS (SELECT x.node, x.depth, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
      FROM x JOIN k ON x.conv_id = k.conv_id AND x.depth <= k.depth GROUP BY x.node, x.depth)
SELECT k.conv_id::BIGINT AS conv_id, k.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, k.n_convs::BIGINT AS n_convs,
       k.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s ON k.node = s.node AND k.depth = s.depth LEFT JOIN n AS p ON k.up = p.node AND p.depth = k.depth - 1
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt first: conversation c begins with the first h turns of conversation c - c % 5."""
    turns = turn_digests(table(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = turns.where("last").select("conv_id", F.col("place").alias("n"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), head.alias("h"))
    heads = turns.where("conv_id % 5 = 0 and place <= 8")                     # h is at most 8
    found = (convs.where("base <> conv_id").join(heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("place").alias("n_base")), "base", "left")
             .withColumn("n_head", F.least(F.coalesce("n_base", F.lit(0)), "h")))
    copied = (found.select("conv_id", "base", "h").join(heads.withColumnRenamed("conv_id", "base"), "base").where("place <= h")
              .select("conv_id", F.col("place").alias("depth"), "h1", "h2", "n_bytes"))
    shifts = found.where("n_head < h").select("conv_id", (F.col("h") - F.col("n_head")).alias("shift"))
    own = (turns.where(F.col("conv_id") % 5 != 0).withColumn("h", head).where("place > h").join(shifts, "conv_id", "left")
           .select("conv_id", (F.col("place") - F.coalesce("shift", F.lit(0))).alias("depth"), "h1", "h2", "n_bytes"))
    bases = turns.where(F.col("conv_id") % 5 == 0).select("conv_id", F.col("place").alias("depth"), "h1", "h2", "n_bytes")
    return prefix_trie(bases.unionByName(copied).unionByName(own), turnless=found.where("n_head = 0 and n <= h").select("conv_id"))
