"""Exact dedup: 128-bit content hash, one row stays, bytes compared in groups.

Built-in functions only.  Texts are grouped by the 128-bit digest of the
normalised text.  The same aggregation keeps the smallest and the largest
text of each digest, byte-wise: they differ exactly when two different texts
share the digest.  Because both are partial aggregates, a group holding a
third of the table leaves each map task as one row.  Digests with a collision
(normally none) are grouped again by the text itself.

Defined results: a null text counts as the empty text; all empty texts are one
group; ``group_size`` counts rows, repeated rows included; a null id never
wins over an id, and a group of null ids has a null ``keep_id`` and all its
rows are marked kept; an empty table gives an empty result; other columns are
ignored by :func:`exact_duplicates` and passed through by :func:`drop_duplicates`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise


def content_hash(text: Column) -> Column:
    """128-bit digest (16 bytes) of a normalised text."""
    return F.unhex(F.md5(text.cast("binary")))


def _normalised(docs: DataFrame, id_col: str, text_col: str,
                normalise: Callable[[Column], Column], digest: Callable[[Column], Column]) -> DataFrame:
    norm = normalise(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), norm.alias("norm"))
    return base.select("doc_id", "norm", digest(F.col("norm")).alias("hash"))


def _groups(base: DataFrame, keep: str) -> tuple[DataFrame, DataFrame | None]:
    """(hash, keep_id, group_size) of hashes with one text, and
    (hash, norm, keep_id, group_size) of the others, or None."""
    best = F.max if keep == "max" else F.min
    found = materialise(
        base.groupBy("hash").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
                                 (F.min("norm") != F.max("norm")).alias("collided")), "exact-groups")
    alike = found.where(~F.col("collided")).drop("collided")
    mixed = found.where("collided").select("hash")
    if mixed.isEmpty():
        return alike, None
    apart = (base.join(mixed, "hash", "left_semi").groupBy("hash", "norm")
             .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return alike, materialise(apart, "exact-collisions")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                     normalise: Callable[[Column], Column] = ascii_lower,
                     digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the smallest or the largest id of a group stays."""
    base = _normalised(docs, id_col, text_col, normalise, digest)
    alike, apart = _groups(base, keep)
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    rows = base.select("doc_id", "hash", sha).join(alike, "hash")
    if apart is not None:
        rows = rows.unionByName(base.select("doc_id", "hash", "norm", sha)
                                .join(apart, ["hash", "norm"]).drop("norm"))
    return rows.select("doc_id", "keep_id", "group_size",
                       F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                    normalise: Callable[[Column], Column] = ascii_lower,
                    digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one row per distinct
    normalised text.  The join key is (hash, id): no group meets in one task."""
    alike, apart = _groups(_normalised(docs, id_col, text_col, normalise, digest), keep)
    norm = normalise(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    h, i = "__exact_hash", "__exact_keep"
    marked = docs.withColumn(h, digest(norm))
    names = [F.col(f"`{c}`") for c in docs.columns]

    def one_of_each(side: DataFrame, on: list[str]) -> DataFrame:
        side = side.select(F.col("hash").alias(h), F.col("keep_id").alias(i), *on)
        hit = (F.col(f"d.{h}") == F.col(f"k.{h}")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col(f"k.{i}"))
        if on:
            hit = hit & (norm == F.col("k.norm"))
        kept = marked.alias("d").join(side.alias("k"), hit, "left_semi")
        keys = [h, f"`{id_col}`"] + ([norm] if on else [])
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(h))
        return kept.withColumn("__exact_nth", first).where("__exact_nth = 1").select(*names)

    out = one_of_each(alike, [])
    return out if apart is None else out.unionByName(one_of_each(apart, ["norm"]))
