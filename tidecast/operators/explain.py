"""Per-month sales explanations.

All months are explained in one set-based job: words of a month ⋈ the
importance table, one window per (month, direction) for the top factors,
and one ``groupBy(month)`` that builds the factor arrays and the summary.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import first_sales

# The reference's summary and report wording (Korean), kept verbatim.
RISE_LABEL = "매출 상승 요인: "
FALL_LABEL = "매출 하락 요인: "
NO_FACTOR_SENTENCE = "분석된 주요 요인이 없습니다."
REPORT_RULE = "=" * 60
REPORT_TITLE = "📊 {month} 매출 분석 보고서"
ACTUAL_LINE = "실제 매출: {value}원"
PREDICTED_LINE = "예측 매출: {value}원"
ERROR_LINE = "오차: {diff}원 ({pct}%)"
RISE_HEADER = "\n📈 매출 상승 요인 (Top 5):"
FALL_HEADER = "\n📉 매출 하락 요인 (Top 5):"
FACTOR_LINE = "  {emoji} {word}: 중요도 {score}"
SUMMARY_LINE = "\n💡 요약: {summary}"
IMPACT_EMOJI = {"high": "🔴", "medium": "🟡", "low": "🟢"}
TOP_FACTORS = 5
SUMMARY_WORDS = 3


def impact(score: Column) -> Column:
    """> 0.7 high, > 0.3 medium, else low."""
    return (F.when(score > 0.7, F.lit("high")).when(score > 0.3, F.lit("medium"))
            .otherwise(F.lit("low")))


def factors(month_words: DataFrame, importance: DataFrame) -> DataFrame:
    """J8 + F4 + T4: (month, direction, rank, word, score, impact), rank <= 5.

    ``month_words`` carries ``pos`` (the word's position in the month's list)
    which breaks score ties the way the reference's stable sort does.
    """
    j = month_words.select("month", "word", "pos").join(
        importance.select("word", "score", "direction"), "word")
    w = Window.partitionBy("month", "direction").orderBy(F.desc("score"), F.asc("pos"))
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_FACTORS)
            .select("month", "direction", "rank", "word", "score", impact(F.col("score")).alias("impact")))


def _joined_top(arr: Column, label: str) -> Column:
    top = F.slice(arr, 1, SUMMARY_WORDS)
    words = F.transform(top, lambda s: s["word"])
    return F.when(F.size(arr) > 0, F.concat(F.lit(label), F.array_join(words, ", ")))


def summary(pos: Column, neg: Column) -> Column:
    """'<rise>: a, b, c | <fall>: d, e' or the default sentence."""
    s = F.concat_ws(" | ", _joined_top(pos, RISE_LABEL), _joined_top(neg, FALL_LABEL))
    return F.when(s == "", F.lit(NO_FACTOR_SENTENCE)).otherwise(s)


def explanations(month_words: DataFrame, importance: DataFrame, sales: DataFrame,
                 predictions: DataFrame | None = None) -> DataFrame:
    """M11 for every month with words: counts, top factors, summary, J4/J5 values.

    actual = that month's first sale (NULL if none); predicted = the
    prediction for the month, else the actual; months whose predicted value
    is NULL or 0 are skipped (the reference's ``if predicted_sales``).
    """
    fac = factors(month_words, importance)
    fstruct = F.struct("rank", "word", "score", "direction", "impact")
    arrays = fac.groupBy("month").agg(
        F.array_sort(F.collect_list(F.when(F.col("direction") == "positive", fstruct)))
         .alias("top_positive_factors"),
        F.array_sort(F.collect_list(F.when(F.col("direction") == "negative", fstruct)))
         .alias("top_negative_factors"))
    counts = (month_words.select("month", "word").join(importance.select("word", F.lit(1).alias("known")), "word", "left")
              .groupBy("month").agg(F.count(F.lit(1)).alias("total_words"),
                                    F.count("known").alias("analyzed_words")))
    first_sale = first_sales(sales).select(F.col("month_str").alias("month"), F.col("sales").alias("actual_sales"))
    out = counts.join(arrays, "month", "left").join(first_sale, "month", "left")
    if predictions is not None:
        out = out.join(predictions.select("month", F.col("predicted").alias("_pred")), "month", "left")
        pred = F.coalesce(F.col("_pred"), F.col("actual_sales"))
    else:
        pred = F.col("actual_sales")
    empty = F.array().cast("array<struct<rank:int,word:string,score:double,direction:string,impact:string>>")
    out = out.select(
        "month", pred.alias("predicted_sales"), "actual_sales", "total_words", "analyzed_words",
        F.coalesce("top_positive_factors", empty).alias("top_positive_factors"),
        F.coalesce("top_negative_factors", empty).alias("top_negative_factors"))
    out = out.where(F.col("predicted_sales").isNotNull() & (F.col("predicted_sales") != 0))
    return out.withColumn("summary", summary(F.col("top_positive_factors"), F.col("top_negative_factors")))


# --- F7 / F8: report text ------------------------------------------------------------
def _whole(c: Column) -> Column:
    """1234567.5 -> '1,234,568' (half-even on the exact value, as Python's ``,.0f``)."""
    return F.format_number(c, 0)


def _fixed(c: Column, digits: int) -> Column:
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def _filled(template: str, **parts: Column) -> Column:
    """A wording template with its ``{names}`` replaced by columns."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(parts[name])
    return F.concat(*pieces)


def _factor_lines(factors_col: Column) -> Column:
    mark = F.create_map(*[F.lit(x) for pair in IMPACT_EMOJI.items() for x in pair])
    return F.array_join(F.transform(factors_col, lambda f: _filled(
        FACTOR_LINE, emoji=mark[f["impact"]], word=f["word"], score=_fixed(f["score"], 2))), "\n")


def report_text() -> Column:
    """The report of one month, from the columns of :func:`explanations`."""
    pred, actual = F.col("predicted_sales"), F.col("actual_sales")
    has_actual = actual.isNotNull() & (actual != 0)
    diff = pred - actual
    pct = diff / actual * 100
    signed = F.concat(F.when(pct < 0, F.lit("")).otherwise(F.lit("+")), _fixed(pct, 1))
    pos, neg = F.col("top_positive_factors"), F.col("top_negative_factors")
    return F.concat_ws(
        "\n", F.lit("\n" + REPORT_RULE), _filled(REPORT_TITLE, month=F.col("month")), F.lit(REPORT_RULE),
        F.when(has_actual, _filled(ACTUAL_LINE, value=_whole(actual))),
        _filled(PREDICTED_LINE, value=_whole(pred)),
        F.when(has_actual, _filled(ERROR_LINE, diff=_whole(diff), pct=signed)),
        F.lit(RISE_HEADER), F.when(F.size(pos) > 0, _factor_lines(pos)),
        F.when(F.size(neg) > 0, F.lit(FALL_HEADER)), F.when(F.size(neg) > 0, _factor_lines(neg)),
        _filled(SUMMARY_LINE, summary=F.col("summary")), F.lit(REPORT_RULE + "\n"))


def report_lines(expl: DataFrame) -> DataFrame:
    """(month, report) - one text block per month; sort + join for the file."""
    return expl.select("month", report_text().alias("report"))
