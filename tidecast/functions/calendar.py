"""Calendar expressions (period keys and time features).

All expressions are built-in Spark functions, so they stay inside
whole-stage codegen, and they work on ``timestamp_ntz`` / ``date`` inputs
without consulting the session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_key(ts, freq: str) -> Column:
    """Period key of a timestamp: day -> date, week -> Monday date, month -> 'yyyy-MM'."""
    ts = _col(ts)
    if freq == "daily":
        return F.to_date(ts)
    if freq == "weekly":
        d = F.to_date(ts)
        return F.date_sub(d, F.weekday(d))
    if freq == "monthly":
        return F.date_format(ts, "yyyy-MM")
    raise ValueError(f"unknown freq {freq!r}")


def period_group_key(ts, freq: str) -> Column:
    """Grouping key as a ``date`` (day, Monday, first of month): cheaper to hash
    and compare than a formatted string; label it after aggregation."""
    ts = _col(ts)
    d = F.to_date(ts)
    if freq == "daily":
        return d
    if freq == "weekly":
        return F.date_sub(d, F.weekday(d))
    if freq == "monthly":
        return F.trunc(d, "MM")
    raise ValueError(f"unknown freq {freq!r}")


def period_label(key, freq: str) -> Column:
    """Date grouping key -> the reference's period value ('yyyy-MM' for months)."""
    key = _col(key)
    return F.date_format(key, "yyyy-MM") if freq == "monthly" else key


def period_start_date(period, freq: str) -> Column:
    """First day of a period key as a ``date``."""
    period = _col(period)
    if freq == "monthly":
        return F.to_date(F.concat(period, F.lit("-01")))
    return period.cast("date")


def next_month_string(as_of) -> Column:
    """'yyyy-MM' of the calendar month after ``as_of`` (December rolls over)."""
    return F.date_format(F.add_months(F.trunc(_col(as_of).cast("date"), "MM"), 1), "yyyy-MM")


def calendar_columns(date_col) -> dict[str, Column]:
    """day_of_week (Monday=0), month number, ISO week of year."""
    d = _col(date_col)
    return {
        "day_of_week": F.weekday(d).cast("bigint"),
        "month": F.month(d).cast("bigint"),
        "week_of_year": F.weekofyear(d).cast("bigint"),
    }


def cyclic_time_columns(date_col) -> dict[str, Column]:
    """month_num, quarter, year and their sine/cosine encodings."""
    d = _col(date_col)
    m = F.month(d)
    q = F.quarter(d)
    two_pi = F.lit(2 * math.pi)
    return {
        "month_num": m.cast("bigint"),
        "quarter": q.cast("bigint"),
        "year": F.year(d).cast("bigint"),
        "month_sin": F.sin(two_pi * m / 12),
        "month_cos": F.cos(two_pi * m / 12),
        "quarter_sin": F.sin(two_pi * q / 4),
        "quarter_cos": F.cos(two_pi * q / 4),
    }


def time_feature_array(ts) -> Column:
    """[month, quarter, year, sin(2πm/12), cos(2πm/12)], zeros when the input is null."""
    d = F.to_date(_col(ts))
    m = F.month(d).cast("double")
    two_pi = F.lit(2 * math.pi)
    vals = [m, F.quarter(d).cast("double"), F.year(d).cast("double"),
            F.sin(two_pi * m / 12), F.cos(two_pi * m / 12)]
    return F.array(*[F.coalesce(v, F.lit(0.0)) for v in vals])


def month_range_filter(ts, year, month) -> Column:
    """ts in [first day of year-month, first day of the next month)."""
    start = F.make_date(F.lit(year) if not isinstance(year, Column) else year,
                        F.lit(month) if not isinstance(month, Column) else month, F.lit(1))
    t = F.to_date(_col(ts))
    return (t >= start) & (t < F.add_months(start, 1))
