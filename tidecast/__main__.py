"""Command-line entry: ``python -m tidecast <job> ...`` (or spark-submit).

Jobs mirror the reference's entry points and read its file formats through
``tidecast.sources.files``; every job also accepts a folder of driver tables.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .params import FREQS, ForecastParams
from .plans import pipelines
from .sources import files


def _spark() -> SparkSession:
    # a cluster supplies master and configuration through spark-submit
    return SparkSession.builder.appName("tidecast").getOrCreate()


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tidecast")
    sub = ap.add_subparsers(dest="job", required=True)

    f = sub.add_parser("forecast", help="period table + features + model + next-period prediction")
    f.add_argument("--orders", help="order CSV (reference columns)")
    f.add_argument("--tables", help="folder of driver parquet tables instead of --orders")
    f.add_argument("--freq", choices=FREQS, default="monthly")
    f.add_argument("--model", choices=("huber", "gbt"), default="huber")
    f.add_argument("--no-retrain", action="store_true", help="use the newest saved model if any")
    f.add_argument("--drop-partial-last", action="store_true", help="leave out a last period that the orders don't reach the end of")
    f.add_argument("--out", required=True)

    c = sub.add_parser("compare", help="forecast quality per time grain")
    c.add_argument("--orders")
    c.add_argument("--tables")
    c.add_argument("--drop-partial-last", action="store_true")
    c.add_argument("--out", required=True)

    w = sub.add_parser("words", help="word importance, top words and per-month explanations")
    w.add_argument("--words", required=True, help="folder of YYYY-MM.json word lists (list or object)")
    w.add_argument("--sales", required=True, help="folder holding the monthly sales CSV")
    w.add_argument("--method", default="gradient_boosting",
                   choices=("ridge", "lasso", "random_forest", "gradient_boosting"))
    w.add_argument("--direction-source", default="importance", choices=("importance", "corr"))
    w.add_argument("--top", type=int, default=10)
    w.add_argument("--month", help="explain only this month (YYYY-MM)")
    w.add_argument("--out", required=True)

    p = sub.add_parser("word-forecast", help="next month's sales from monthly word scores")
    p.add_argument("--scores", required=True, help="folder of YYYY-MM.json {word: score} files")
    p.add_argument("--sales", required=True)
    p.add_argument("--word-offset", type=int, default=1, choices=(0, 1), help="months from the words learned from to the target")
    p.add_argument("--out", required=True)

    i = sub.add_parser("items", help="top items per keyword x month, deduplicated by URL")
    i.add_argument("--dump", help="line-JSON item dump")
    i.add_argument("--tables")
    i.add_argument("--per-month", type=int, default=10)
    i.add_argument("--year", type=int, help="dump mode: keep items of this year only")
    i.add_argument("--out", required=True)

    a = ap.parse_args(argv)
    spark = _spark()
    if a.job in ("forecast", "compare"):
        facts = a.tables or files.load_orders_csv(spark, a.orders)
        if a.job == "forecast":
            res = pipelines.run_demand_forecast(spark, facts, a.out, ForecastParams(freq=a.freq, drop_partial_last=a.drop_partial_last),
                                                a.model, retrain=not a.no_retrain)
        else:
            frame = pipelines.run_comparison(spark, facts, drop_partial_last=a.drop_partial_last)
            frame.write.mode("overwrite").json(f"{a.out}/comparison")
            res = [r.asDict() for r in frame.collect()]
    elif a.job == "words":
        words, bad = files.load_word_lists(spark, a.words)
        sales = files.load_sales_csv(spark, a.sales)
        res = pipelines.run_word_analysis(spark, words, sales, a.out, a.method, a.top, month=a.month,
                                         direction_source=a.direction_source)
        res["quarantined_files"] = bad.select("month").distinct().count()
    elif a.job == "word-forecast":
        scores, _ = files.load_word_scores(spark, a.scores)
        res = pipelines.run_word_forecast(spark, scores, a.out, sales=files.load_sales_csv(spark, a.sales),
                                          word_offset=a.word_offset)
    else:
        if a.dump:
            from .operators.items import normalise_record
            raw, bad = files.load_item_dump(spark, a.dump)
            # collection order = order in the dump; keyword of the search, '' if absent.
            # normalise_record turns dates to ISO; the year filter reads 'yyyyMMdd'.
            items = (normalise_record(raw, keep=["seq_no", F.coalesce(F.col("keyword"), F.lit("")).alias("keyword")])
                     .withColumn("upload_date", F.regexp_replace(F.substring("upload_date", 1, 10), "-", "")))
            res = pipelines.run_collection(spark, items, a.out, mode="dump", year=a.year)
            res["quarantined_lines"] = bad.count()
        else:
            res = pipelines.run_collection(spark, a.tables, a.out, a.per_month)
    print(json.dumps(res, default=str))


if __name__ == "__main__":
    main()
