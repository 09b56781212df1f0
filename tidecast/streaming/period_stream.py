"""ST1: incremental period aggregates from arriving event / order files.

File-source ``readStream`` -> ``foreachBatch``: each micro-batch is aggregated
to (period, keys) partials - counts, sums and distinct-count sketches, all of which
add up - and written to a folder of its own, ``batch=<id>``.  The result is the
sum of all partials.  So a late file is as good as an early one: there is no watermark, no
window is ever closed, nothing is thrown away and no state is held; a batch
that runs again after a failure overwrites its own folder only.

:func:`compact` keeps the folders few: it merges all live partials into one ``compact=`` folder and
then commits a new version of the manifest (which batch the merged folders reach, and their names), by
one rename.  Readers take the newest manifest's folders and the batches after it.  A compaction that ends half-way has
committed nothing; what it left is not in any manifest.  A batch that the manifest covers may run again:
its folder is not read.  Folders go one compaction after they were replaced, so that results read before stay valid.

* Offsets live under a checkpoint folder of the shared checkpoint root, so a
  restarted query resumes exactly where it stopped.
* The wall-clock value is turned into an epoch-aligned ``timestamp`` WITHOUT
  consulting the session time zone, so daily windows start at
  midnight whatever ``spark.sql.session.timeZone`` says.
* Distinct counts are HyperLogLog sketches, or exact bitmaps of integer ids; both merge. Months roll
  up in batch over the daily partials.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distinct
from ..session import scratch_path

WEEK_START_OFFSET = "4 days"   # epoch day 0 is a Thursday: +4 days -> Monday windows


def epoch_aligned(ts: Column) -> Column:
    """``timestamp_ntz`` wall clock -> ``timestamp`` with the same digits in UTC."""
    micros = (F.unix_date(F.to_date(ts)).cast("bigint") * F.lit(86_400_000_000)
              + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * F.lit(1_000_000)
              + (F.date_part(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("bigint"))
    return F.timestamp_micros(micros)


def window_day(c: Column) -> Column:
    """Window start (epoch-aligned timestamp) -> its calendar date, time-zone free."""
    return F.date_from_unix_date(F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int"))


def period_partials(batch: DataFrame, ts_col: str, keys: list[str], value_col: str,
                    freq: str = "daily", distinct_col: str | None = None, exact_distinct: str | None = None) -> DataFrame:
    """(period, keys) -> event count and value sum (+ distinct sketch) of one micro-batch; with ``exact_distinct``
    (an integer column) one row per bucket of ids, with their bitmap."""
    et = epoch_aligned(F.col(ts_col))
    if freq == "daily":
        win = F.window(et, "1 day")
    elif freq == "weekly":
        win = F.window(et, "7 days", startTime=WEEK_START_OFFSET)
    else:
        raise ValueError("streams aggregate daily or weekly; months roll up in batch")
    aggs = [F.count(F.lit(1)).alias("n_events"), F.sum(value_col).alias("total_value")]
    extra = []
    if distinct_col:
        aggs.append(F.hll_sketch_agg(distinct_col).alias("distinct_sketch"))
        extra = ["distinct_sketch"]
    buckets = []
    if exact_distinct:
        buckets = [distinct.bucket_of(F.col(exact_distinct)).alias(distinct.BUCKET)]
        aggs.append(distinct.bits_of(F.col(exact_distinct)).alias(distinct.BITS))
        extra += [distinct.BUCKET, distinct.BITS]
    return (batch.groupBy(win.alias("w"), *keys, *buckets).agg(*aggs)
            .select(window_day(F.col("w.start")).alias("period"), *keys, "n_events", "total_value", *extra))


def merged(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partials of any number of batches, in any order, added up."""
    aggs = [F.sum("n_events").alias("n_events"), F.sum("total_value").alias("total_value")]
    if "distinct_sketch" in partials.columns:
        aggs.append(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))
    if distinct.BITS in partials.columns:
        keys = [*keys, distinct.BUCKET]
        aggs.append(F.bitmap_or_agg(distinct.BITS).alias(distinct.BITS))
    return partials.groupBy("period", *keys).agg(*aggs)


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, pattern: str) -> list[str]:
    _, p, fs = _files(spark, pattern)
    return sorted(str(x.getPath().getName()) for x in (fs.globStatus(p) or []))


def _manifest(spark: SparkSession, out_path: str, version: str | None = None) -> tuple[int, dict]:
    """(version, manifest) of the newest commit, or of one version; (0, nothing covered) before the first."""
    versions = [version] if version else _names(spark, f"{out_path}/manifest/v*")
    if not versions:
        return 0, {"through": -1, "folders": []}
    line = spark.read.text(f"{out_path}/manifest/{versions[-1]}", wholetext=True).first()[0]
    return int(versions[-1][1:]), json.loads(line)


def _batches(spark: SparkSession, out_path: str) -> dict[int, str]:
    return {int(n.split("=")[1]): n for n in _names(spark, f"{out_path}/batch=*")}


def live_folders(spark: SparkSession, out_path: str) -> list[str]:
    """Folders that make up the result: the newest manifest's, and the batches after it."""
    out_path = out_path.rstrip("/")
    _, manifest = _manifest(spark, out_path)
    later = [n for i, n in sorted(_batches(spark, out_path).items()) if i > manifest["through"]]
    return [f"{out_path}/{n}" for n in [*manifest["folders"], *later]]


def result(spark: SparkSession, out_path: str, keys: list[str]) -> DataFrame | None:
    """The stream's table so far; distinct counts as ``approx_distinct`` (sketches) or ``n_distinct`` (bitmaps)."""
    folders = live_folders(spark, out_path)
    if not folders:
        return None
    out = merged(spark.read.parquet(*folders), keys)
    if distinct.BITS in out.columns:
        sketch = [F.hll_union_agg("distinct_sketch").alias("distinct_sketch")] if "distinct_sketch" in out.columns else []
        out = out.groupBy("period", *keys).agg(F.sum("n_events").alias("n_events"), F.sum("total_value").alias("total_value"), *sketch,
                                               F.sum(F.bitmap_count(distinct.BITS)).alias("n_distinct"))
    if "distinct_sketch" in out.columns:
        out = out.withColumn("approx_distinct", F.hll_sketch_estimate("distinct_sketch")).drop("distinct_sketch")
    return out


def compact(spark: SparkSession, out_path: str, keys: list[str]) -> None:
    """Merge the live partials into one folder, commit it, and drop what the commit before had replaced."""
    out_path = out_path.rstrip("/")
    version, manifest = _manifest(spark, out_path)
    batches = _batches(spark, out_path)
    through = max([manifest["through"], *batches])
    folders = live_folders(spark, out_path)
    if len(folders) < 2:
        return
    name = f"compact={through:012d}-{uuid.uuid4().hex[:8]}"
    merged(spark.read.parquet(*folders), keys).write.parquet(f"{out_path}/{name}")
    commit(spark, out_path, version + 1, {"through": through, "folders": [name]})
    kept = {name, *manifest["folders"]}
    gone = [n for i, n in batches.items() if i <= manifest["through"]]
    gone += [n for n in _names(spark, f"{out_path}/compact=*") if n not in kept]
    for n in gone:
        _, p, fs = _files(spark, f"{out_path}/{n}")
        fs.delete(p, True)
    for n in _names(spark, f"{out_path}/manifest/v*")[:-2]:
        _, p, fs = _files(spark, f"{out_path}/manifest/{n}")
        fs.delete(p, False)


def commit(spark: SparkSession, out_path: str, version: int, manifest: dict) -> None:
    """Make a manifest the newest: written whole beside its place, then renamed; a version is committed once."""
    hadoop, draft, fs = _files(spark, f"{out_path}/manifest/draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    final = hadoop.Path(f"{out_path}/manifest/v{version:012d}")
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {version} of {out_path} was committed by another job")


def run_available(spark: SparkSession, source_dir: str, file_glob: str, schema, ts_col: str,
                  keys: list[str], value_col: str, freq: str = "daily",
                  out_path: str | None = None, checkpoint: str | None = None,
                  distinct_col: str | None = None, files_per_batch: int = 100,
                  exact_distinct: str | None = None, compact_every: int = 0) -> DataFrame:
    """Process every file available now, then stop; returns the result table.

    With ``compact_every`` = n, partials are compacted after every n batches: fewer than 2n + 2 folders remain,
    however many batches run.

    ``maxFilesPerTrigger`` bounds a micro-batch when a backlog of files is
    waiting; the result is the same for any split into batches and any order of files."""
    out_path = (out_path or scratch_path(spark, f"stream-{freq}-out")).rstrip("/")
    checkpoint = checkpoint or scratch_path(spark, f"stream-{freq}-state")
    src = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
           .option("maxFilesPerTrigger", files_per_batch).parquet(source_dir))

    def write_partials(batch: DataFrame, epoch: int) -> None:
        (period_partials(batch, ts_col, keys, value_col, freq, distinct_col, exact_distinct)
         .write.mode("overwrite").parquet(f"{out_path}/batch={epoch:012d}"))
        if compact_every and (epoch + 1) % compact_every == 0:
            compact(batch.sparkSession, out_path, keys)

    q = (src.writeStream.foreachBatch(write_partials)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    out = result(spark, out_path, keys)
    if out is None:
        empty = spark.createDataFrame([], schema)
        out = merged(period_partials(empty, ts_col, keys, value_col, freq), keys)
    return out


def monthly_rollup(daily: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Batch roll-up of the stream's daily partials to months ('yyyy-MM'):
    counts and sums add up exactly (``window()`` has no month intervals)."""
    return (daily.groupBy(F.date_format("period", "yyyy-MM").alias("period"), *keys)
            .agg(F.sum("n_events").alias("n_events"), F.sum("total_value").alias("total_value")))
