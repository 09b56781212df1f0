"""Feature scaling with the reference's (scikit-learn) conventions (M3-M5).

Spark ML's scalers differ (``StandardScaler`` divides by the sample std,
``MinMaxScaler`` maps a constant column to 0.5), so the statistics are one
global aggregate - a single row of 2 x F numbers, computed with map-side
partial aggregation.  ``*_stats`` leave it a one-row frame that ``*_scaled`` attach
to every row, so nothing passes the driver; ``fit_*`` and ``*_expr`` do the same with
the numbers themselves, as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timeseries as ts
from .words import with_scalars


@dataclass
class StandardStats:
    mean: dict[str, float]
    std: dict[str, float]          # population std; 0 is replaced by 1 when applied


@dataclass
class MinMaxStats:
    lo: dict[str, float]
    hi: dict[str, float]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def standard_stats(df: DataFrame, cols: list[str], weight: str | None = None) -> DataFrame:
    """ONE row: ``_m_<c>`` and ``_s_<c>``, mean and population std of every column (0 std: 1; no values: 0 and 1).

    With ``weight`` row r counts that many times, as if repeated.  Deviations are
    summed around the mean, which costs a second pass over ``df`` and no digits: hand in a written table."""
    if weight is None:
        return df.agg(*[F.coalesce(F.avg(_q(c).cast("double")), F.lit(0.0)).alias(f"_m_{c}") for c in cols],
                      *[F.coalesce(F.nullif(F.stddev_pop(_q(c).cast("double")), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in cols])
    w = _q(weight).cast("double")
    total = {c: F.sum(F.when(_q(c).isNotNull(), w)) for c in cols}
    mean = df.agg(*[F.coalesce(F.try_divide(F.sum(_q(c).cast("double") * w), total[c]), F.lit(0.0)).alias(f"_m_{c}") for c in cols])
    off = {c: _q(c).cast("double") - _q(f"_m_{c}") for c in cols}
    var = {c: F.try_divide(F.sum(off[c] * off[c] * w), total[c]) for c in cols}
    spread = with_scalars(df, mean).agg(*[F.coalesce(F.nullif(F.sqrt(var[c]), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in cols])
    return with_scalars(mean, spread)


def standard_scaled(df: DataFrame, stats: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """M3: z-scores ``<c><suffix>`` by a one-row frame of ``standard_stats``, attached without a driver trip."""
    out = with_scalars(df, stats).withColumns({f"{c}{suffix}": (_q(c).cast("double") - _q(f"_m_{c}")) / _q(f"_s_{c}") for c in cols})
    return out.drop(*[f"_{k}_{c}" for c in cols for k in "ms"])


def window_weights(df: DataFrame, length: int, validation_share: float, *, order_col: str = "period", name: str = "weight") -> DataFrame:
    """How many of the training windows of ``length`` rows hold each row: the weight that pools
    statistics over windows without building them.

    Window i (rows i-L .. i-1, target row i) exists for i >= L; of N of them the first floor(N * (1 - v)) train."""
    w = ts.series_window(order_col)
    row, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy())
    windows = F.greatest(n - length, F.lit(0))
    last = F.lit(length) + F.floor(windows * F.lit(1.0 - validation_share)) - 1
    held = F.least(row + length, last) - F.greatest(row + 1, F.lit(length)) + 1
    return df.withColumn(name, F.greatest(held, F.lit(0)))


def minmax_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """ONE row: ``_lo_<c>`` and ``_range_<c>`` of every column (0 range: 1; no values: 0 and 1)."""
    lo, hi = {c: F.min(_q(c).cast("double")) for c in cols}, {c: F.max(_q(c).cast("double")) for c in cols}
    return df.agg(*[F.coalesce(lo[c], F.lit(0.0)).alias(f"_lo_{c}") for c in cols],
                  *[F.coalesce(F.nullif(hi[c] - lo[c], F.lit(0.0)), F.lit(1.0)).alias(f"_range_{c}") for c in cols])


def minmax_scaled(df: DataFrame, stats: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """M4: values in 0..1 as ``<c><suffix>``; the statistics' columns stay for ``minmax_restored``."""
    return with_scalars(df, stats).withColumns({f"{c}{suffix}": (_q(c).cast("double") - _q(f"_lo_{c}")) / _q(f"_range_{c}") for c in cols})


def minmax_restored(scaled: Column, name: str) -> Column:
    """M5: a scaled value in the units of column ``name`` again."""
    return scaled * _q(f"_range_{name}") + _q(f"_lo_{name}")


def fit_standard(df: DataFrame, cols: list[str]) -> StandardStats:
    """The statistics as numbers."""
    row = df.agg(*[F.avg(_q(c).cast("double")).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(_q(c).cast("double")).alias(f"s_{c}") for c in cols]).first()
    return StandardStats({c: float(row[f"m_{c}"] or 0.0) for c in cols}, {c: float(row[f"s_{c}"] or 0.0) for c in cols})


def standard_expr(c: Column | str, name: str, stats: StandardStats) -> Column:
    c = _q(c) if isinstance(c, str) else c
    s = stats.std[name] or 1.0
    return (c.cast("double") - F.lit(stats.mean[name])) / F.lit(s)


def fit_minmax(df: DataFrame, cols: list[str]) -> MinMaxStats:
    row = df.agg(*[F.min(_q(c)).alias(f"lo_{c}") for c in cols],
                 *[F.max(_q(c)).alias(f"hi_{c}") for c in cols]).first()
    return MinMaxStats({c: float(row[f"lo_{c}"] or 0.0) for c in cols},
                       {c: float(row[f"hi_{c}"] or 0.0) for c in cols})


def _range(stats: MinMaxStats, c: str) -> float:
    r = stats.hi[c] - stats.lo[c]
    return r if r != 0 else 1.0


def minmax_expr(c: Column | str, name: str, stats: MinMaxStats) -> Column:
    c = _q(c) if isinstance(c, str) else c
    return (c.cast("double") - F.lit(stats.lo[name])) / F.lit(_range(stats, name))


def inverse_minmax_expr(c: Column | str, name: str, stats: MinMaxStats | None) -> Column:
    if stats is None:
        raise ValueError("scaler is not fitted")
    c = _q(c) if isinstance(c, str) else c
    return c * F.lit(_range(stats, name)) + F.lit(stats.lo[name])
