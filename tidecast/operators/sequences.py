"""Lag-window sequence datasets.

A training sample for row i is the feature vectors of rows i-L .. i-1 plus
the target of row i.  ``collect_list`` over ``rowsBetween(-L, -1)`` builds the
window in one pass; arrays stay arrays (no L x F explode) until a long view is
asked for.  Windows over a series are bounded by L, never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import series_window


def _dbl_array(cols: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def build_sequences(df: DataFrame, features: list[str], target: str, length: int, *,
                    extras: list[str] | None = None, same_period_extras: bool = True,
                    order_col: str = "period", series_keys=()) -> DataFrame:
    """W9 (and W8 with ``extras=None``): one row per target period i >= L.

    Columns: series keys, ``order_col``, ``x_seq`` array<array<double>> (oldest
    first), ``x_extra`` array<double>, ``y`` double, ``x_last`` (row i-1 = W11).
    ``same_period_extras=True`` takes the extras of row i itself (the
    reference); False takes row i-1's, which carry no target leakage.
    """
    w = series_window(order_col, series_keys)
    seq = F.collect_list(_dbl_array(features)).over(w.rowsBetween(-length, -1))
    if extras:
        ex = _dbl_array(extras)
        x_extra = ex if same_period_extras else F.lag(ex, 1).over(w)
    else:
        x_extra = F.array(F.lit(0.0))
    out = df.select(*series_keys, order_col, seq.alias("x_seq"), x_extra.alias("x_extra"),
                    F.col(target).cast("double").alias("y"))
    out = out.where(F.size("x_seq") == length)
    return out.withColumn("x_last", F.element_at("x_seq", -1))


def next_window(df: DataFrame, features: list[str], length: int, *,
                extras: list[str] | None = None, order_col: str = "period",
                series_keys=()) -> DataFrame:
    """The window for the period AFTER the last observed one (D4 fixed):
    the last L observed rows, oldest first, and the last row's extras."""
    w = series_window(order_col, series_keys)
    seq = F.collect_list(_dbl_array(features)).over(w.rowsBetween(-(length - 1), 0))
    ex = _dbl_array(extras) if extras else F.array(F.lit(0.0))
    tagged = df.select(*series_keys, order_col, seq.alias("x_seq"), ex.alias("x_extra"))
    last = (tagged.groupBy(*series_keys) if series_keys else tagged.groupBy()).agg(
        F.max(order_col).alias(order_col))
    keys = [*series_keys, order_col]
    return (tagged.join(last, keys, "left_semi")
            .where(F.size("x_seq") == length))


def last_training_window(seq: DataFrame, *, order_col: str = "period", series_keys=()) -> DataFrame:
    """The newest row of ``build_sequences`` per series, which the reference predicts the "next" period
    from although its target is the last observed period (D4, for parity).  An aggregate, not a window."""
    columns = [c for c in seq.columns if c not in series_keys]
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.col(order_col)).alias("newest")
    rows = seq.groupBy(*series_keys).agg(newest)
    return rows.where(F.col("newest").isNotNull()).select(*series_keys, "newest.*")


def sequences_long(seq: DataFrame, features: list[str], order_col: str = "period",
                   series_keys=()) -> DataFrame:
    """(keys, period, step 1..L oldest first, feature, value) view of ``x_seq``."""
    names = F.array(*[F.lit(c) for c in features])
    a = seq.select(*series_keys, order_col, F.posexplode("x_seq").alias("p", "vec"))
    b = a.select(*series_keys, order_col, (F.col("p") + 1).alias("step"),
                 F.posexplode("vec").alias("fp", "value"))
    return b.select(*series_keys, order_col, "step",
                    F.element_at(names, F.col("fp") + 1).alias("feature"), "value")
