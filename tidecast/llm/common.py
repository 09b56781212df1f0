"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise  # noqa: F401 - re-exported for the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text) of any table: other columns, whatever their names,
    are left behind, so they can't clash with an operator's own."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def fold(id_column: Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; null ids fold as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(labels: DataFrame, learn: Column, label_col: str, id_col: str, rows_per_class: int) -> DataFrame:
    """(doc_id, label): of each class (0, 1) the ``rows_per_class`` distinct ids of smallest hash where ``learn``.

    A class is never ranked whole: counts of the hash's first 16 bits (65,536 a class at most)
    bound what can be drawn, and only rows up to that bound are ranked."""
    rows = (labels.where(learn).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
            .where("doc_id is not null and label in (0, 1)").distinct().withColumn("hash", F.xxhash64("doc_id")).withColumn("first", F.shiftright("hash", 48)))
    counts = rows.groupBy("label", "first").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("label").orderBy("first")))
    bound = upto.groupBy("label").agg(F.min(F.when(F.col("upto") >= rows_per_class, F.col("first"))).alias("bound"))       # two rows
    near = rows.join(F.broadcast(bound), "label").where(F.col("first") <= F.coalesce("bound", "first"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("hash", "doc_id"))
    return near.withColumn("nth", nth).where(F.col("nth") <= rows_per_class).select("doc_id", "label")


def parts_for(rows: int, rows_per_part: int, least: int = 1) -> int:
    """A partition count that grows with the rows."""
    return max(least, -(-int(rows) // rows_per_part))


def tidy(run):
    """A task's function over batches that hands freed memory back to the system
    when it ends: workers are reused, and what they hold counts against their executor."""
    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    return tidied


_HELD: dict = {}


def held(key, build):
    """An object that a Python worker builds once and keeps from task to task, until
    another operator's takes its place: only one is kept, to bound the worker's memory."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]
