"""Distributed dense ordinal index (a DataFrame form of ``zipWithIndex``).

``row_number() over (order by k)`` without a partition runs in ONE task.
Here the distinct keys are range-partitioned by a sort, each row gets its
position inside its partition from ``monotonically_increasing_id`` (the
partition id lives in the upper 31 bits), and per-partition counts - one
number per partition - give the offsets.  The ranked frame is written once
to the shared checkpoint folder and re-read, so both passes see the same
rows and partitions even under AQE or a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def dense_index(keys: DataFrame, col: str, index_col: str = "idx") -> DataFrame:
    """(col, idx) with idx = 0-based rank of the distinct, ascending keys."""
    mid = F.monotonically_increasing_id()
    ranked = materialise(keys.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
                         .select(col, F.spark_partition_id().alias("_pid"), mid.alias("_mid")),
                         "dense-index")
    counts = sorted((r["_pid"], r["n"]) for r in
                    ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = {}, 0
    for pid, n in counts:
        offsets[pid] = acc
        acc += n
    if not offsets:
        return ranked.select(col, F.lit(0).cast("bigint").alias(index_col)).limit(0)
    off = F.create_map(*[x for pid, o in offsets.items() for x in (F.lit(pid), F.lit(o))])
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return ranked.select(col, (off[F.col("_pid")] + local).cast("bigint").alias(index_col))


def split_rank(df: DataFrame, keys: list[str], order: list[Column], rank_col: str = "rank",
               rank_type: str = "int") -> DataFrame:
    """``row_number()`` over (keys, order) without one task per key.

    Rows are range-partitioned by (keys, order) and written once with their
    partition number; a row's rank is its place inside (keys, partition)
    plus the rows of the key in earlier partitions, one count per (keys, partition).
    """
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    placed = materialise(spread.withColumn("_part", F.spark_partition_id()), "split-rank")
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n"))
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    b = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    hit = F.col("_part") == F.col("_p")
    for c in same:
        hit = hit & c
    return (placed.withColumn("_within", within).join(b, hit)
            .withColumn(rank_col, (F.col("_within") + F.col("_before")).cast(rank_type))
            .select(*df.columns, rank_col))
