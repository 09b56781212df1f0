"""Collected items kept one per key while dumps keep arriving (S2, SRC6).

The table lies in ``n_buckets`` buckets by a hash of the key.  A batch is first
reduced to its own first rows, then merged with the buckets it touches; only those
are written anew, and a manifest that names every bucket's folder makes the new version
the table by one rename.  A job that dies before that leaves the table as it was, and running
its batch again gives the same rows: of a key the smallest ``order_col`` stays, of
equal ones the row of smallest hash, whatever the split into batches and their order.

The bucket count is fixed by the first batch; take it so that a bucket has about a gigabyte.  One
job writes at a time: of two, the later commit raises.
Defined results: NULL keys are one key; a NULL order value comes after all others; later batches may lack columns (NULL) or bring new ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..sources.files import list_files
from ..streaming.period_stream import commit

N_BUCKETS = 64
BUCKET = "_bucket"


def _versions(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """The commits that are kept (two at most), oldest first."""
    found = []
    for name in list_files(spark, f"{path}/manifest/v*"):
        found.append((int(name.rsplit("/v", 1)[1]), json.loads(spark.read.text(name, wholetext=True).first()[0])))
    return found


def _firsts(rows: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key: least order value, ties by the hash of the row (a partial aggregate)."""
    columns = sorted(rows.columns)
    place = F.struct(F.col(f"`{order_col}`").isNull(), F.col(f"`{order_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    kept = rows.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), place).alias("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def items(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of the newest commit; None before the first."""
    path, versions = path.rstrip("/"), _versions(spark, path.rstrip("/"))
    return _read(spark, path, versions[-1][1]["buckets"].values()) if versions else None


def _read(spark: SparkSession, path: str, folders) -> DataFrame | None:
    folders = [f"{path}/{f}" for f in sorted(folders)]
    return spark.read.option("mergeSchema", True).parquet(*folders) if folders else None


def upsert(batch: DataFrame, path: str, key: str = "url", order_col: str = "seq_no", n_buckets: int = N_BUCKETS) -> int:
    """Merge a batch of items into the table at ``path``; returns how many buckets were written anew."""
    spark, path = batch.sparkSession, path.rstrip("/")
    versions = _versions(spark, path)
    version, manifest = versions[-1] if versions else (0, {"n_buckets": n_buckets, "buckets": {}})
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(manifest["n_buckets"])).cast("int")
    fresh = materialise(_firsts(batch, key, order_col).withColumn(BUCKET, bucket), "arriving-items")
    touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())                # n_buckets at most
    if not touched and versions:
        return 0
    rows = fresh.drop(BUCKET)
    before = _read(spark, path, [manifest["buckets"][str(b)] for b in touched if str(b) in manifest["buckets"]])
    if before is not None:
        rows = _firsts(before.unionByName(rows, allowMissingColumns=True), key, order_col)
    folder = f"upsert={version + 1:012d}-{uuid.uuid4().hex[:8]}"
    (rows.withColumn(BUCKET, bucket).hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{path}/{folder}"))
    if not touched:                                                                       # an empty first batch keeps its columns
        rows.write.parquet(f"{path}/{folder}/{BUCKET}=none")
    buckets = {**manifest["buckets"], **{str(b): f"{folder}/{BUCKET}={b}" for b in touched or ["none"]}}
    if touched:
        buckets.pop("none", None)
    commit(spark, path, version + 1, {"n_buckets": manifest["n_buckets"], "buckets": buckets})
    _drop_replaced(spark, path, [*buckets.values(), *manifest["buckets"].values()])
    return len(touched)


def _drop_replaced(spark: SparkSession, path: str, kept: list[str]) -> None:
    """Delete bucket folders that neither the newest commit nor the one before names, and older manifests."""
    fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = fs_of(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = set(kept)
    for status in fs.globStatus(fs_of(f"{path}/upsert=*/{BUCKET}=*")) or []:
        at = status.getPath()
        if f"{at.getParent().getName()}/{at.getName()}" not in held:
            fs.delete(at, True)
    for name in list_files(spark, f"{path}/manifest/v*")[:-2]:
        fs.delete(fs_of(name), False)
