"""Positional features of series of any length.

``timeseries`` runs one window per series, which is right for period tables: a
series is bounded by the calendar there.  A series of raw rows (orders,
readings) is not, and a window over it is one task.  Here every row gets its
position in its series from a range-partitioned sort (``split_rank``), the
series is cut into blocks of ``rows_per_block`` positions, and the last
``back`` rows of each block are copied to the next one.  A window inside
(series, block) then sees all it needs, so the functions of ``timeseries`` give the
same values as over the whole series.  Copies are dropped at the end.

Defined results: rows with one order value stand in the order of
``tie_cols`` (without them: in any order, as in a plain window); NULL series
keys are a series of their own; an empty frame gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import timeseries as ts
from .indexing import split_rank

ROWS_PER_BLOCK = 10_000
POS, BLOCK, COPY = "_series_pos", "_series_block", "_series_copy"


def positions(df: DataFrame, order_col: str, series_keys=(), tie_cols=()) -> DataFrame:
    """``df`` with ``_series_pos``: the row's 0-based place in its series, found in many tasks."""
    ranked = split_rank(df, list(series_keys), [F.col(c) for c in (order_col, *tie_cols)], POS, "long")
    return ranked.withColumn(POS, F.col(POS) - 1)


def in_blocks(df: DataFrame, back: int, features: Callable[[DataFrame, str, list[str]], DataFrame], *,
              order_col: str = "period", series_keys=(), tie_cols=(), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``features(frame, order_col, series_keys)`` run per block; it may look at most ``back`` rows back.

    A block never holds fewer positions than ``back``, so one copy of a row is enough."""
    size = max(rows_per_block, back, 1)
    placed = positions(df, order_col, series_keys, tie_cols)
    block = F.floor(F.col(POS) / size)
    copied = (F.col(POS) % size) >= size - back
    owners = F.when(copied, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = (placed.withColumn(COPY, F.explode(owners))
            .withColumn(BLOCK, block + F.col(COPY).cast("long")))
    out = features(rows, POS, [*series_keys, BLOCK])
    return out.where(~F.col(COPY)).drop(POS, BLOCK, COPY)


def add_time_series_features(df: DataFrame, target: str, lags: list[int], windows: list[int], *, yoy_lag: int = 12,
                             trailing: int | None = None, fill_all: bool = True, order_col: str = "period",
                             series_keys=(), tie_cols=(), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """W1, W4, W6 and, with ``trailing``, W7, in the reference's order (lags, rolling, growth, final fill)."""
    back = max([*lags, *[k - 1 for k in windows], 1, yoy_lag, (trailing or 1) - 1])

    def features(rows, order, keys):
        out = ts.add_lags(rows, target, lags, order_col=order, series_keys=keys)
        out = ts.add_rolling(out, target, windows, order_col=order, series_keys=keys)
        if trailing:
            out = ts.trailing_stats(out, target, trailing, order_col=order, series_keys=keys)
        return ts.add_growth(out, target, order_col=order, series_keys=keys, yoy_lag=yoy_lag, fill_all=fill_all)

    return in_blocks(df, back, features, order_col=order_col, series_keys=series_keys, tie_cols=tie_cols,
                     rows_per_block=rows_per_block)


def chrono_split(df: DataFrame, validation_share: float = 0.2, *, order_col: str = "period", series_keys=(),
                 tie_cols=()) -> DataFrame:
    """The first ``floor(n * (1 - v))`` rows of every series are training, the rest validation.

    The cut of a series comes from its row count, a partial aggregate joined back on the keys."""
    placed = positions(df, order_col, series_keys, tie_cols)
    cut = F.floor(F.count(F.lit(1)) * F.lit(1.0 - validation_share)).alias("_series_cut")
    same, cuts = F.lit(True), placed.groupBy(*series_keys).agg(cut)
    for i, k in enumerate(series_keys):
        cuts = cuts.withColumnRenamed(k, f"_series_key{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"_series_key{i}"))
    split = F.when(F.col(POS) < F.col("_series_cut"), F.lit("train")).otherwise(F.lit("validation"))
    return placed.join(cuts, same).select(*df.columns, split.alias("split"))
