"""Sinks (SNK1-SNK7): period tables, prediction records, scores, reports,
items and model persistence."""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_period_table(df: DataFrame, path: str, freq: str, fmt: str = "parquet") -> None:
    """SNK1: the processed period table, partitioned by grain; rewriting one
    grain replaces only its partition (dynamic partition overwrite)."""
    # Rows in period order (a period table is calendar-bounded, so the
    # range-partitioned sort is small)
    w = (df.withColumn("freq", F.lit(freq)).orderBy("period").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("freq"))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def prediction_frame(spark: SparkSession, record: dict, execution_time: str | None = None) -> DataFrame:
    """SNK2: the reference's nested prediction JSON layout as one row."""
    ev = {k: record.get(k) for k in ("MAE", "MSE", "RMSE", "R2", "MAPE")}
    row = {
        "status": record.get("status"),
        "training": {"n_samples": record.get("n_samples"), "model": record.get("model")},
        "evaluation": ev,
        "prediction": {"freq": record.get("freq"), "last_period": record.get("last_period"),
                       "last_value": record.get("last_value"),
                       "predicted_value": record.get("predicted_value"),
                       "change_percent": record.get("change_percent"),
                       "timestamp": record.get("timestamp")},
        "execution_time": execution_time,
    }
    schema = ("status string, training struct<n_samples:bigint,model:string>, "
              "evaluation struct<MAE:double,MSE:double,RMSE:double,R2:double,MAPE:double>, "
              "prediction struct<freq:string,last_period:string,last_value:double,"
              "predicted_value:double,change_percent:double,timestamp:string>, execution_time string")
    return spark.createDataFrame([row], schema)


def write_prediction(spark: SparkSession, record: dict, path: str, execution_time: str | None = None) -> None:
    """SNK2 / SNK3: one JSON object per run."""
    prediction_frame(spark, record, execution_time).coalesce(1).write.mode("overwrite").json(path)


def word_prediction_frame(spark: SparkSession, record: dict) -> DataFrame:
    """SNK3: the word pipeline's record - status, prediction, data_info, timestamp."""
    row = {"status": record.get("status"), "prediction": record.get("predicted_value"),
           "data_info": {"n_samples": record.get("n_samples"), "n_word_columns": record.get("n_word_columns"),
                         "sequence_length": record.get("sequence_length"),
                         "last_period": record.get("last_period"), "source_month": record.get("source_month")},
           "timestamp": record.get("timestamp")}
    schema = ("status string, prediction double, data_info struct<n_samples:bigint,n_word_columns:bigint,"
              "sequence_length:bigint,last_period:string,source_month:string>, timestamp string")
    return spark.createDataFrame([row], schema)


def write_word_prediction(spark: SparkSession, record: dict, path: str) -> None:
    word_prediction_frame(spark, record).coalesce(1).write.mode("overwrite").json(path)


def write_word_scores(importance: DataFrame, path: str) -> None:
    """SNK4: (word, score, raw_importance, direction), highest score first."""
    importance.orderBy(F.desc("score"), F.asc("word")).write.mode("overwrite").json(path)


def write_importance_object(importance: DataFrame, path: str) -> None:
    """SNK4 in the reference's layout: one JSON object with ``word_scores`` (highest first) and
    ``feature_importance``.  One object means one task and one row; :func:`write_word_scores` has no such limit."""
    words = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), "word", "score", "raw_importance", "direction")))
    (importance.agg(words.alias("w")).select(
        F.map_from_entries(F.transform("w", lambda x: F.struct(x["word"], x["score"]))).alias("word_scores"),
        F.map_from_entries(F.transform("w", lambda x: F.struct(x["word"], F.struct(x["score"].alias("score"), x["raw_importance"].alias("raw_importance"),
                                                                                   x["direction"].alias("direction"))))).alias("feature_importance"))
     .coalesce(1).write.mode("overwrite").json(path))


def write_word_files(texts: DataFrame, directory: str) -> None:
    """(month, value) -> ``<directory>/<month>.json``, one file a month, as ``files.load_word_scores`` reads them.

    Tasks write the files; the driver renames them, one a month.  A month that is there already is replaced."""
    spark, directory = texts.sparkSession, directory.rstrip("/")
    drafts = f"{directory}/_drafts-{uuid.uuid4().hex[:8]}"
    texts.select("month", "value").repartition("month").write.partitionBy("month").text(drafts)
    hadoop, written, fs = _file_system(spark, f"{drafts}/month=*/part-*")
    for status in fs.globStatus(written) or []:
        month = str(status.getPath().getParent().getName()).split("=", 1)[1]
        final = hadoop.Path(f"{directory}/{month}.json")
        fs.delete(final, False)
        if not fs.rename(status.getPath(), final):
            raise RuntimeError(f"{final} could not be written")
    fs.delete(hadoop.Path(drafts), True)


def score_files(scores: DataFrame) -> DataFrame:
    """(month, word, score) -> (month, value): each month's scores as one JSON object, words in order."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "score"))))
    return scores.where("month is not null and word is not null").groupBy("month").agg(F.to_json(pairs).alias("value"))


def write_report(reports: DataFrame, path: str) -> None:
    """SNK5: the all-months report, one block per month in month order.

    A report has one row per month (calendar-bounded), so one output file.
    """
    reports.orderBy("month").select("report").coalesce(1).write.mode("overwrite").text(path)


def write_items(items: DataFrame, json_path: str, csv_path: str | None = None) -> bool:
    """SNK6: JSON always; CSV only when there is at least one item."""
    items.write.mode("overwrite").json(json_path)
    if csv_path and items.limit(1).count() > 0:
        items.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(csv_path)
        return True
    return False


MARK = "_COMMITTED"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_model(model, base: str, now: _dt.datetime | None = None, state: dict | None = None) -> str:
    """SNK7: one folder ``<base>/model_<yyyyMMdd_HHmmss_ffffff>_<random>`` with ``model``, ``state`` (columns,
    scalers, target range) and a commit mark that is created last; returns the path.  A save that
    ends half-way leaves a folder without the mark, which no reader looks at; two saves never share a folder."""
    spark = SparkSession.getActiveSession()
    ts = (now or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y%m%d_%H%M%S_%f")
    path = f"{base.rstrip('/')}/model_{ts}_{uuid.uuid4().hex[:8]}"
    model.write().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{path}/state")
    hadoop, mark, fs = _file_system(spark, f"{path}/{MARK}")
    fs.create(mark, False).close()
    return path


def committed_models(spark: SparkSession, base: str) -> list[str]:
    """Folders of finished saves, oldest first."""
    hadoop, pattern, fs = _file_system(spark, f"{base.rstrip('/')}/model_*/{MARK}")
    return sorted(str(s.getPath().getParent().toString()) for s in (fs.globStatus(pattern) or []))


def latest_model_path(spark: SparkSession, base: str) -> str | None:
    """Newest finished save (timestamped names sort chronologically)."""
    saved = committed_models(spark, base)
    return saved[-1] if saved else None


def load_latest_model(spark: SparkSession, base: str, model_cls):
    """The newest saved model, or None when there is none (then train)."""
    path = latest_model_path(spark, base)
    return model_cls.load(f"{path}/model") if path else None


def load_latest(spark: SparkSession, base: str, model_cls) -> tuple | None:
    """The newest saved (model, state), or None when there is none (then train)."""
    path = latest_model_path(spark, base)
    if path is None:
        return None
    lines = spark.read.text(f"{path}/state").collect()                         # one line
    return model_cls.load(f"{path}/model"), json.loads(lines[0]["value"])
