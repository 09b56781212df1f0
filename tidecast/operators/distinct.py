"""Exact distinct counts that add up: bitmaps of integer ids by bucket.

A bucket holds 32,768 neighbouring ids as 4 KB of bits.  Bitmaps of parts (days, batches, files) merge
by OR into those of the whole, so a distinct count never needs the ids again; a hot key is spread over its
buckets, and a part's bucket is one row however often an id occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .indexing import dense_index

BUCKET = "id_bucket"
BITS = "id_bits"


def bucket_of(ids: Column) -> Column:
    return F.bitmap_bucket_number(ids.cast("long"))


def bits_of(ids: Column) -> Column:
    """Aggregate: the bits of one bucket's ids (nulls set none)."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(ids.cast("long")))


def count_merged(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_distinct) of bitmap rows (keys, id_bucket, id_bits) of any number of parts."""
    whole = bitmaps.where(f"{BUCKET} is not null").groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))
    return whole.groupBy(*keys).agg(F.sum(F.bitmap_count(BITS)).alias("n_distinct"))


def integer_ids(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` as integers: as it is, or numbered by a distributed index (names have no bitmap)."""
    if isinstance(df.schema[column].dataType, IntegralType):
        return df
    index = dense_index(df.select(column), column, "_number")
    return df.join(index, column, "left").withColumn(column, F.col("_number")).drop("_number")
