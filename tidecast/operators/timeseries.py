"""Positional time-series features over period tables.

All frames are row based (``rowsBetween``): gaps between periods are not
filled, as in the reference.  The windows run after aggregation, so a series
holds one row per period (bounded by the calendar, not by the data volume);
``long_series`` runs the same functions over series of any length.
``series_keys`` partitions the windows, so many series (per category,
customer, part, ...) spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_window(order_col: str = "period", series_keys: list[str] | tuple = ()) -> Window:
    w = Window.orderBy(order_col)
    return Window.partitionBy(*series_keys).orderBy(order_col) if series_keys else w


def add_lags(df: DataFrame, target: str, lags: list[int], *, order_col: str = "period",
             series_keys=(), fill: float | None = None) -> DataFrame:
    """W1 (``fill=None``: NULL until filled later) / W2 (``fill=0``: filled at once)."""
    w = series_window(order_col, series_keys)
    cols = {}
    for k in lags:
        c = F.lag(F.col(target), k).over(w)
        cols[f"{target}_lag_{k}"] = F.coalesce(c, F.lit(float(fill))) if fill is not None else c
    return df.withColumns(cols)


def add_rolling(df: DataFrame, target: str, windows: list[int], *, order_col: str = "period",
                series_keys=()) -> DataFrame:
    """Mean / sample std / min / max over the last k rows, NULL until k values exist."""
    base = series_window(order_col, series_keys)
    cols = {}
    x = F.col(target)
    for k in windows:
        w = base.rowsBetween(-(k - 1), 0)
        full = F.count(x).over(w) == k
        cols[f"{target}_ma_{k}"] = F.when(full, F.avg(x).over(w))
        cols[f"{target}_std_{k}"] = F.when(full, F.stddev_samp(x).over(w))
        cols[f"{target}_min_{k}"] = F.when(full, F.min(x).over(w))
        cols[f"{target}_max_{k}"] = F.when(full, F.max(x).over(w))
    return df.withColumns(cols)


def pct_change(x: Column, prev: Column) -> Column:
    """x / prev - 1 with pandas' inf/NaN -> 0 (``try_divide`` never raises under ANSI)."""
    return F.coalesce(F.try_divide(x, prev) - F.lit(1.0), F.lit(0.0))


def add_growth(df: DataFrame, target: str, *, order_col: str = "period", series_keys=(),
               yoy_lag: int = 12, fill_all: bool = True) -> DataFrame:
    """1-row and 12-row percentage change, then NULL -> 0 over the whole frame.

    The reference only creates the yoy column when the series has more than
    12 rows; here the column always exists (stable schema) and is 0 for
    series of 12 rows or fewer (no row has another 12 rows before it), which is
    what a consumer of the filled frame sees either way.
    """
    w = series_window(order_col, series_keys)
    x = F.col(target)
    out = df.withColumns({
        f"{target}_mom_growth": pct_change(x, F.lag(x, 1).over(w)),
        f"{target}_yoy_growth": pct_change(x, F.lag(x, yoy_lag).over(w)),
    })
    return fill_numeric_nulls(out) if fill_all else out


def fill_numeric_nulls(df: DataFrame, value: float = 0.0) -> DataFrame:
    """The reference's final ``fillna(0)`` (numeric columns only)."""
    return df.na.fill(value)


def trailing_stats(df: DataFrame, col: str, window: int = 3, *, order_col: str = "period",
                   series_keys=()) -> DataFrame:
    """Mean, population std, min, max over trailing PARTIAL windows (no gate)."""
    w = series_window(order_col, series_keys).rowsBetween(-(window - 1), 0)
    x = F.col(col)
    return df.withColumns({
        f"{col}_tmean_{window}": F.avg(x).over(w),
        f"{col}_tstd_{window}": F.coalesce(F.stddev_pop(x).over(w), F.lit(0.0)),
        f"{col}_tmin_{window}": F.min(x).over(w),
        f"{col}_tmax_{window}": F.max(x).over(w),
    })


def add_time_series_features(df: DataFrame, target: str, lags: list[int], windows: list[int],
                             *, order_col: str = "period", series_keys=()) -> DataFrame:
    """Pipeline order of the reference: lags, rolling, growth (+ final fill)."""
    out = add_lags(df, target, lags, order_col=order_col, series_keys=series_keys)
    out = add_rolling(out, target, windows, order_col=order_col, series_keys=series_keys)
    return add_growth(out, target, order_col=order_col, series_keys=series_keys)


def chrono_split(df: DataFrame, validation_share: float = 0.2, *, order_col: str = "period",
                 series_keys=()) -> DataFrame:
    """First ``floor(n * (1 - v))`` rows are training, the rest validation."""
    w = series_window(order_col, series_keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*series_keys))
    rn = F.row_number().over(w)
    return df.withColumn(
        "split", F.when(rn <= F.floor(n * F.lit(1.0 - validation_share)), F.lit("train"))
                  .otherwise(F.lit("validation")))


def change_percent(pred: Column, last: Column) -> Column:
    """(pred - last) / last * 100, 0 when last is 0."""
    return F.coalesce(F.try_divide(pred - last, last) * F.lit(100.0), F.lit(0.0))


def last_observation(df: DataFrame, value: str, *, order_col: str = "period",
                     series_keys=()) -> DataFrame:
    """Last period and its value per series (``max_by``: a partial aggregate)."""
    g = df.groupBy(*series_keys) if series_keys else df.groupBy()
    return g.agg(F.max(order_col).alias("last_period"),
                 F.max_by(F.col(value), F.col(order_col)).alias("last_value"))
