"""Registered queries: monthly words, word importance and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as ex
from ..operators import words as wd
from ..params import MIN_DATA_MONTHS
from ..session import materialise
from ..sources.tables import monthly_sales, monthly_word_lists, monthly_word_scores, shared_word_lists, shared_word_scores
from .registry import comparable, register
from .sql_blocks import cast_wrap

# The tokens of the driver tables' part names (the test vocabulary),
# used to spell the oracle's wide word-score columns.
TEST_VOCABULARY = ["anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old",
                   "plate", "red", "ring", "rod", "small", "widget"]

WORD_CTES = """
pp AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, l_partkey, count(*) AS n
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
tok AS (SELECT month, unnest(string_split(p_name, ' ')) AS word, n FROM pp JOIN part ON l_partkey = p_partkey),
wc AS (SELECT month, word, sum(n) AS n_lines FROM tok WHERE word <> '' GROUP BY 1, 2),
wa AS (SELECT month, word, row_number() OVER (PARTITION BY month ORDER BY n_lines DESC, word) AS pos,
              n_lines / max(n_lines) OVER (PARTITION BY month) AS score,
              n_lines * (SELECT sum(n_lines) FROM wc) > sum(n_lines) OVER (PARTITION BY word)
                * sum(n_lines) OVER (PARTITION BY month) AS present FROM wc),
wl AS (SELECT month, word, pos, score FROM wa WHERE present),
sales AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS sales
          FROM orders GROUP BY 1),
sm AS (SELECT strftime(month, '%Y-%m') AS month_str, arg_min(sales, (month, sales)) AS sales FROM sales GROUP BY 1),
tr AS (SELECT m.month, sm.sales FROM (SELECT DISTINCT month FROM wl) m JOIN sm ON m.month = sm.month_str),
vocab AS (SELECT DISTINCT word FROM wl),
vocab_all AS (SELECT DISTINCT word FROM wa),
grid AS (SELECT v.word, tr.month, tr.sales,
                CASE WHEN wl.word IS NULL THEN 0.0 ELSE 1.0 END AS x
         FROM vocab v CROSS JOIN tr LEFT JOIN wl ON wl.word = v.word AND wl.month = tr.month),
raw AS (SELECT word, CASE WHEN var_pop(x) = 0 OR var_pop(sales) = 0 THEN 0.0
                          ELSE coalesce(corr(x, sales), 0.0) END AS r FROM grid GROUP BY word),
imp AS (SELECT word,
               CASE WHEN max(abs(r)) OVER () > 0 THEN abs(r) / max(abs(r)) OVER () ELSE abs(r) END AS score,
               r AS raw_importance,
               CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM raw)"""


def wsql(body: str) -> str:
    return f"WITH {WORD_CTES}\n{body}"


def _inputs(spark, sf_dir):
    """Word lists (presence) and monthly sales, each written once: several branches of a plan read them."""
    return shared_word_lists(spark, sf_dir), materialise(monthly_sales(spark, sf_dir), "month-sales")


def _scored(spark, sf_dir):
    """Word scores of all tokens and monthly sales."""
    return shared_word_scores(spark, sf_dir), materialise(monthly_sales(spark, sf_dir), "month-sales")


@register("word_lists", cast_wrap(wsql("SELECT month, word, CAST(pos AS INTEGER) AS pos, score, present FROM wa"),
                                  ["score"]))
def word_lists(spark, sf_dir):
    """SRC4 shape: every token of every month with its position, score and presence in the list."""
    return comparable(monthly_word_scores(spark, sf_dir))


@register("vocabulary", wsql("SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS idx FROM vocab"))
def vocabulary(spark, sf_dir):
    return wd.vocabulary(monthly_word_lists(spark, sf_dir))


@register("multi_hot_long", wsql("""
SELECT DISTINCT wl.month, wl.word, v.idx FROM wl
JOIN (SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS idx FROM vocab) v USING (word)"""))
def multi_hot_long(spark, sf_dir):
    words = shared_word_lists(spark, sf_dir)
    return wd.multi_hot_long(words, wd.vocabulary(words))


def _matrix_sql():
    cols = ", ".join(
        f"CAST(coalesce(max(CASE WHEN wa.word = '{w}' THEN wa.score END), 0) AS FLOAT) AS \"word_score_{w}\""
        for w in TEST_VOCABULARY)
    return wsql(f"""
SELECT CAST(s.month AS VARCHAR) AS month, CAST(s.sales AS FLOAT) AS sales, {cols}
FROM sales s LEFT JOIN wa ON wa.month = strftime(s.month, '%Y-%m')
GROUP BY s.month, s.sales""")


@register("word_score_matrix", _matrix_sql())
def word_score_matrix(spark, sf_dir):
    words, sales = _scored(spark, sf_dir)
    return comparable(wd.word_score_matrix(sales, words.select("month", "word", "score")))


@register("next_month_words", wsql("""
, ls AS (SELECT max(strftime(month, '%Y-%m')) AS last_sale FROM sales),
tg AS (SELECT strftime(CAST(strptime(last_sale || '-01', '%Y-%m-%d') AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS target FROM ls),
ch AS (SELECT target, CASE WHEN EXISTS (SELECT 1 FROM wa WHERE month = target) THEN target
                           ELSE (SELECT max(month) FROM wa) END AS chosen FROM tg)
SELECT ch.target AS target_month, ch.chosen AS source_month, v.word,
       CAST(coalesce(w.score, 0) AS FLOAT) AS score
FROM vocab_all v CROSS JOIN ch LEFT JOIN wa w ON w.word = v.word AND w.month = ch.chosen"""))
def next_month_words(spark, sf_dir):
    words, sales = _scored(spark, sf_dir)
    return comparable(wd.next_month_vector(words, sales))


@register("word_training_set", wsql("""
SELECT tr.month, CAST(tr.sales AS FLOAT) AS sales, count(*) AS n_words,
       array_to_string(list_sort(list(wl.word)), '|') AS words
FROM tr JOIN wl USING (month) GROUP BY tr.month, tr.sales"""))
def word_training_set(spark, sf_dir):
    words, sales = _inputs(spark, sf_dir)
    t = wd.training_set(words, sales)
    return comparable(t.select("month", "sales", F.size("words").cast("bigint").alias("n_words"),
                               F.array_join("words", "|").alias("words")))


@register("word_correlation_scores", cast_wrap(wsql("SELECT * FROM imp"), ["score", "raw_importance"]))
def word_correlation_scores(spark, sf_dir):
    words, sales = _inputs(spark, sf_dir)
    return comparable(wd.correlation_scores(words, sales))


@register("top_words_by_direction", cast_wrap(wsql("""
SELECT direction_filter, CAST(rank AS INTEGER) AS rank, word, score, direction FROM (
  SELECT d.direction_filter, i.*, row_number() OVER (PARTITION BY d.direction_filter ORDER BY i.score DESC, i.word) AS rank
  FROM imp i JOIN (SELECT 'all' AS direction_filter UNION ALL SELECT 'positive' UNION ALL SELECT 'negative') d
    ON d.direction_filter = 'all' OR d.direction_filter = i.direction) x
WHERE rank <= 10"""), ["score"]))
def top_words_by_direction(spark, sf_dir):
    words, sales = _inputs(spark, sf_dir)
    return comparable(wd.top_words_all_directions(wd.correlation_scores(words, sales), 10))


_FACTORS_SQL = """
fac AS (SELECT month, direction, rank, word, score,
               CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.3 THEN 'medium' ELSE 'low' END AS impact
        FROM (SELECT wl.month, wl.word, i.score, i.direction,
                     row_number() OVER (PARTITION BY wl.month, i.direction ORDER BY i.score DESC, wl.pos) AS rank
              FROM wl JOIN imp i USING (word)) x WHERE rank <= 5)"""


@register("explain_factors", cast_wrap(wsql(f""", {_FACTORS_SQL.strip()}
SELECT month, direction, CAST(rank AS INTEGER) AS rank, word, score, impact FROM fac"""), ["score"]))
def explain_factors(spark, sf_dir):
    words, sales = _inputs(spark, sf_dir)
    return comparable(ex.factors(words, wd.correlation_scores(words, sales)))


_EXPLAIN_CTES = """
agg AS (SELECT month, count(*) FILTER (WHERE direction = 'positive') AS n_pos,
               count(*) FILTER (WHERE direction = 'negative') AS n_neg,
               concat_ws(' | ', {pos}, {neg}) AS s
        FROM fac GROUP BY month),
cnt AS (SELECT wl.month, count(*) AS total_words, count(i.word) AS analyzed_words
        FROM wl LEFT JOIN imp i USING (word) GROUP BY wl.month),
ex AS (SELECT cnt.month, sm.sales AS predicted_sales, sm.sales AS actual_sales,
              total_words, analyzed_words, CAST(coalesce(n_pos, 0) AS INTEGER) AS n_pos,
              CAST(coalesce(n_neg, 0) AS INTEGER) AS n_neg,
              CASE WHEN coalesce(s, '') = '' THEN '{none}' ELSE s END AS summary
       FROM cnt LEFT JOIN agg USING (month) LEFT JOIN sm ON sm.month_str = cnt.month
       WHERE sm.sales IS NOT NULL AND sm.sales <> 0)"""


def _summary_part(direction, label):
    return (f"CASE WHEN count(*) FILTER (WHERE direction = '{direction}') > 0 THEN '{label}' || "
            f"array_to_string(list(word ORDER BY rank) FILTER (WHERE direction = '{direction}' AND rank <= 3), ', ') END")


def _explain_sql(body: str) -> str:
    ctes = _EXPLAIN_CTES.format(pos=_summary_part("positive", ex.RISE_LABEL),
                                neg=_summary_part("negative", ex.FALL_LABEL),
                                none=ex.NO_FACTOR_SENTENCE)
    return wsql(f", {_FACTORS_SQL.strip()},{ctes}\n{body}")


@register("explain_summary", _explain_sql(
    "SELECT month, CAST(predicted_sales AS FLOAT) AS predicted_sales, CAST(actual_sales AS FLOAT) AS actual_sales, "
    "total_words, analyzed_words, n_pos, n_neg, summary FROM ex"))
def explain_summary(spark, sf_dir):
    words, sales = _inputs(spark, sf_dir)
    e = ex.explanations(words, wd.correlation_scores(words, sales), sales)
    return comparable(e.select("month", "predicted_sales", "actual_sales", "total_words", "analyzed_words",
                               F.size("top_positive_factors").alias("n_pos"),
                               F.size("top_negative_factors").alias("n_neg"), "summary"))


def _sq(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _report_sql():
    emo = ex.IMPACT_EMOJI

    def block(direction):
        line = (f"'  ' || CASE impact WHEN 'high' THEN '{emo['high']}' WHEN 'medium' THEN '{emo['medium']}' "
                f"ELSE '{emo['low']}' END || ' ' || word || ': 중요도 ' || format('{{:.2f}}', score)")
        return (f"NULLIF(coalesce(string_agg({line}, chr(10) ORDER BY rank) "
                f"FILTER (WHERE direction = '{direction}'), ''), '')")

    has_actual = "(ex.actual_sales IS NOT NULL AND ex.actual_sales <> 0)"
    title_pre, title_post = ex.REPORT_TITLE.split("{month}")
    act_pre, act_post = ex.ACTUAL_LINE.split("{value}")
    pred_pre, pred_post = ex.PREDICTED_LINE.split("{value}")
    err_pre, rest = ex.ERROR_LINE.split("{diff}")
    err_mid, rest = rest.split("{pct}")
    sum_pre, sum_post = ex.SUMMARY_LINE.split("{summary}")
    body = f"""
SELECT ex.month, concat_ws(chr(10),
  chr(10) || {_sq(ex.REPORT_RULE)},
  {_sq(title_pre)} || ex.month || {_sq(title_post)},
  {_sq(ex.REPORT_RULE)},
  CASE WHEN {has_actual} THEN {_sq(act_pre)} || format('{{:,.0f}}', ex.actual_sales) || {_sq(act_post)} END,
  {_sq(pred_pre)} || format('{{:,.0f}}', ex.predicted_sales) || {_sq(pred_post)},
  CASE WHEN {has_actual} THEN {_sq(err_pre)} || format('{{:,.0f}}', ex.predicted_sales - ex.actual_sales)
       || {_sq(err_mid)} || format('{{:+.1f}}', (ex.predicted_sales - ex.actual_sales) / ex.actual_sales * 100)
       || {_sq(rest)} END,
  {_sq(ex.RISE_HEADER)},
  fl.pos_lines,
  CASE WHEN fl.neg_lines IS NOT NULL THEN {_sq(ex.FALL_HEADER)} END,
  fl.neg_lines,
  {_sq(sum_pre)} || ex.summary || {_sq(sum_post)},
  {_sq(ex.REPORT_RULE)} || chr(10)) AS report
FROM ex LEFT JOIN (SELECT month, {block('positive')} AS pos_lines, {block('negative')} AS neg_lines
                   FROM fac GROUP BY month) fl USING (month)"""
    return _explain_sql(body)


@register("explain_report_lines", _report_sql())
def explain_report_lines(spark, sf_dir):
    """One report text per explained month (number formatting: see explain.py)."""
    words, sales = _inputs(spark, sf_dir)
    e = ex.explanations(words, wd.correlation_scores(words, sales), sales)
    return ex.report_lines(e)


@register("coverage_info", wsql("""
SELECT array_to_string(list_sort(list(DISTINCT wa.month)), '|') AS input_data_months,
       (SELECT array_to_string(list_sort(list(DISTINCT strftime(month, '%Y-%m'))), '|') FROM sales) AS sales_data_months,
       (SELECT count(*) FROM sales) AS total_sales_months,
       CAST(count(DISTINCT wa.month) AS BIGINT) AS total_input_months
FROM wa"""))
def coverage_info(spark, sf_dir):
    """Months present in the word data and in the sales data."""
    words, sales = _scored(spark, sf_dir)
    info = wd.coverage_info(words, sales)
    return info.withColumns({"input_data_months": F.array_join("input_data_months", "|"),
                             "sales_data_months": F.array_join("sales_data_months", "|")})


def _word_seq_sql():
    cells = ", ".join(
        f"coalesce(max(CASE WHEN wa.word = '{w}' THEN wa.score END), 0) AS \"word_score_{w}\""
        for w in TEST_VOCABULARY)
    cols = ", ".join(f'"word_score_{w}"' for w in TEST_VOCABULARY)
    return wsql(f"""
, mx AS (SELECT s.month, strftime(s.month, '%Y-%m') AS period, s.sales, {cells}
         FROM sales s LEFT JOIN wa ON wa.month = strftime(s.month, '%Y-%m') GROUP BY s.month, s.sales),
t AS (SELECT *, row_number() OVER (ORDER BY period) AS rn FROM mx),
u AS (UNPIVOT (SELECT rn, {cols}, sales FROM t) ON {cols}, sales INTO NAME feature VALUE value)
SELECT r.period, CAST(s.rn - r.rn + 13 AS INTEGER) AS step, u.feature, CAST(u.value AS FLOAT) AS value
FROM t r JOIN t s ON s.rn BETWEEN r.rn - 12 AND r.rn - 1 JOIN u ON u.rn = s.rn
WHERE r.rn > 12""")


@register("word_sequences", _word_seq_sql())
def word_sequences(spark, sf_dir):
    """12-month windows of (word scores ++ sales), long view (sales last)."""
    from ..operators import sequences as sq
    words, sales = _scored(spark, sf_dir)
    m = wd.word_score_matrix(sales, words.select("month", "word", "score"))
    feats = sorted(c for c in m.columns if c.startswith("word_score_")) + ["sales"]
    m = m.withColumn("period", F.date_format("month", "yyyy-MM"))
    seq = sq.build_sequences(m, feats, "sales", 12)
    return comparable(sq.sequences_long(seq, feats).withColumn("step", F.col("step").cast("int")))


@register("word_data_gate", wsql("""
SELECT CAST((SELECT count(DISTINCT month) FROM wa) AS BIGINT) AS n_word_months,
       CAST((SELECT count(*) FROM sales) AS BIGINT) AS n_sales_months,
       CASE WHEN greatest((SELECT count(DISTINCT month) FROM wa), (SELECT count(*) FROM sales)) >= 6
            THEN 'success' ELSE 'insufficient_data' END AS status"""))
def word_data_gate(spark, sf_dir):
    """PF12 of the word pipeline: enough months in either input (>= 6)."""
    words, sales = _scored(spark, sf_dir)
    w = words.agg(F.countDistinct("month").cast("bigint").alias("n_word_months"))
    s = sales.agg(F.count(F.lit(1)).cast("bigint").alias("n_sales_months"))
    g = wd.with_scalars(w, s)
    return g.withColumn("status", F.when(F.greatest("n_word_months", "n_sales_months") >= MIN_DATA_MONTHS,
                                         F.lit("success")).otherwise(F.lit("insufficient_data")))
