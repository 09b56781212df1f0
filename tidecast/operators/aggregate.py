"""Period aggregation, pivots and profiles (A1-A9, J1, PF1, PF5, PF13).

The reference scans the order table six times (one base aggregate plus five
pivot tables) and chains five left merges on ``period``.  Here the order
facts are scanned ONCE: each order yields a base row and one row per pivot
key, a single ``groupBy(period, key, value)`` partially aggregates them
before the only shuffle, and the small long result is widened by a
conditional aggregation - no join at all (a period without rows for a pivot
value gets 0, exactly what the left merge + ``fillna(0)`` produced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import (calendar_columns, period_group_key, period_key, period_label,
                                  period_start_date)
from ..session import materialise
from .words import with_scalars

BASE_COLUMNS = ["order_count", "total_sales", "avg_order_value", "std_order_value",
                "total_quantity", "avg_quantity", "unique_customers", "avg_delivery_time",
                "std_delivery_time", "avg_rating"]

MAX_PIVOT_VALUES = 10_000


@dataclass(frozen=True)
class PivotSpec:
    column: str            # pivot key column of the order facts
    prefix: str            # output column prefix
    measure: str           # "sum" of order_total, or "count" of order_id (as double)
    underscore_spaces: bool = False

    def name(self, value: str) -> str:
        v = value.replace(" ", "_") if self.underscore_spaces else value
        return f"{self.prefix}{v}"


# The five pivots of the reference (key, prefix, measure).
PIVOTS = [
    PivotSpec("category", "cat_sales_", "sum"),
    PivotSpec("customer_segment", "seg_sales_", "sum"),
    PivotSpec("delivery_status_x", "delivery_", "count", underscore_spaces=True),
    PivotSpec("sentiment", "sentiment_", "count"),
    PivotSpec("payment_method", "payment_", "sum"),
]
PIVOT_BY_NAME = {"category": PIVOTS[0], "segment": PIVOTS[1], "delivery": PIVOTS[2],
                 "sentiment": PIVOTS[3], "payment": PIVOTS[4]}


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


BASE_KEY = "__all__"


def _base_only(c: Column) -> Column:
    return F.when(F.col("k") == BASE_KEY, c)


def base_aggregates() -> list[Column]:
    """Per-period statistics; NaN -> 0 as the reference's ``fillna(0)``.

    Sample std of a one-row period is NULL in Spark, NaN in pandas -> 0 in both.
    Exactly one distinct aggregate (customers) keeps the plan to a single
    two-phase distinct aggregation (no Expand of several distinct columns).
    """
    return [
        F.count("order_id").alias("order_count"),
        _z(F.sum("order_total")).alias("total_sales"),
        _z(F.avg(_base_only(F.col("order_total")))).alias("avg_order_value"),
        _z(F.stddev_samp(_base_only(F.col("order_total")))).alias("std_order_value"),
        _z(F.sum(_base_only(F.col("quantity"))).cast("double")).alias("total_quantity"),
        _z(F.avg(_base_only(F.col("quantity")))).alias("avg_quantity"),
        F.countDistinct(_base_only(F.col("customer_id_x"))).alias("unique_customers"),
        _z(F.avg(_base_only(F.col("delivery_time_minutes")))).alias("avg_delivery_time"),
        _z(F.stddev_samp(_base_only(F.col("delivery_time_minutes")))).alias("std_delivery_time"),
        _z(F.avg(_base_only(F.col("rating")))).alias("avg_rating"),
    ]


def period_partials(facts: DataFrame, freq: str, specs: list[PivotSpec], with_base: bool = True) -> DataFrame:
    """ONE scan of the order facts -> (period, k, v, statistics), long and small.

    Every order contributes a base row (k = ``__all__``) and one row per pivot
    key (k = key column, v = its value); a single ``groupBy(period, k, v)``
    with map-side partial aggregation reduces them before the only shuffle.
    The result has periods x (1 + pivot values) rows, whatever the data size.
    """
    entries = []
    if with_base:
        entries.append(F.struct(F.lit(BASE_KEY).alias("k"), F.lit(None).cast("string").alias("v")))
    entries += [F.struct(F.lit(sp.column).alias("k"), F.col(sp.column).cast("string").alias("v"))
                for sp in specs]
    # without base rows only the pivot measures are read, so Catalyst prunes the
    # columns (and the joins) the base statistics would need
    measures = (["order_id", "order_total", "quantity", "customer_id_x", "delivery_time_minutes", "rating"]
                if with_base else ["order_id", "order_total"])
    rows = (facts.where(F.col("order_date").isNotNull())
            .select(period_group_key("order_date", freq).alias("period"), *measures,
                    F.explode(F.array(*entries)).alias("kv"))
            .select("period", "kv.k", "kv.v", *measures)
            .where((F.col("k") == BASE_KEY) | F.col("v").isNotNull()))
    aggs = base_aggregates() if with_base else [F.count("order_id").alias("order_count"),
                                                _z(F.sum("order_total")).alias("total_sales")]
    agg = rows.groupBy("period", "k", "v").agg(*aggs)
    return agg.withColumn("period", period_label(F.col("period"), freq))


def pivot_values_of(partials: DataFrame, specs: list[PivotSpec],
                    max_values: int = MAX_PIVOT_VALUES) -> dict[str, list[str]]:
    """Sorted distinct values per pivot key, read from the small partials
    (bounded: more than ``max_values`` raises instead of widening the schema)."""
    cols = [sp.column for sp in specs]
    rows = (partials.where(F.col("k") != BASE_KEY).select("k", "v").distinct()
            .limit(max_values + 1).collect())
    if len(rows) > max_values:
        raise ValueError(f"more than {max_values} pivot values; keep the data long instead")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["k"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def _widen(partials: DataFrame, specs: list[PivotSpec], values: dict[str, list[str]],
           with_base: bool = True) -> tuple[DataFrame, list[str]]:
    """Long partials -> one row per period: base statistics + pivot cells (0 if absent)."""
    base = F.col("k") == BASE_KEY
    aggs = [F.max(F.when(base, F.col(c))).alias(c) for c in BASE_COLUMNS] if with_base else []
    names = []
    for sp in specs:
        measure = F.col("total_sales") if sp.measure == "sum" else F.col("order_count").cast("double")
        for v in values.get(sp.column, []):
            hit = (F.col("k") == sp.column) & (F.col("v") == v)
            aggs.append(_z(F.max(F.when(hit, measure))).alias(sp.name(v)))
            names.append(sp.name(v))
    return partials.groupBy("period").agg(*aggs), names


def _materialise(partials: DataFrame) -> DataFrame:
    """The partials are read twice (values, then the wide table); writing the
    small table once to the shared folder keeps the big scan to one pass."""
    return materialise(partials, "period-partials")


def aggregate_periods(facts: DataFrame, freq: str = "monthly", *,
                      pivots: list[PivotSpec] | None = None,
                      pivot_values: dict[str, list[str]] | None = None,
                      month_as_date: bool = False) -> DataFrame:
    """A1 (+ A3-A7 and J1 when ``pivots`` is given): one row per period.

    Columns: period, 10 statistics, date, day_of_week, month, week_of_year,
    pivot columns in reference order, and ``year_month`` for monthly data.
    ``month_as_date`` reproduces the pipeline's ``month := date``.
    Without pivots this is one lazy ``groupBy(period)``; with pivots and no
    given values, the big input is still scanned once (see ``period_partials``).
    """
    pivots = pivots or []
    if not pivots:
        p = period_group_key("order_date", freq).alias("period")
        agg = (facts.where(F.col("order_date").isNotNull()).withColumn("k", F.lit(BASE_KEY))
               .groupBy(p).agg(*base_aggregates())
               .withColumn("period", period_label(F.col("period"), freq)))
        pivot_cols: list[str] = []
    else:
        partials = period_partials(facts, freq, pivots)
        if pivot_values is None:
            partials = _materialise(partials)
            pivot_values = pivot_values_of(partials, pivots)
        agg, pivot_cols = _widen(partials, pivots, pivot_values)
    return finished(agg, pivot_cols, freq, month_as_date, bool(pivots))


def finished(agg: DataFrame, pivot_cols: list[str], freq: str, month_as_date: bool, with_pivots: bool) -> DataFrame:
    """One row per period -> the period table: calendar columns added, columns in the reference's order."""
    date = period_start_date("period", freq)
    cal = calendar_columns(date)
    month = date if month_as_date else cal["month"]
    out = [F.col("period"), *[F.col(c) for c in BASE_COLUMNS], date.alias("date"),
           cal["day_of_week"].alias("day_of_week"), month.alias("month"),
           cal["week_of_year"].alias("week_of_year"), *[F.col(f"`{c}`") for c in pivot_cols]]
    if freq == "monthly" and with_pivots:
        out.append(F.col("period").alias("year_month"))
    return agg.select(*out)


def pivot_table(facts: DataFrame, name: str, freq: str = "monthly",
                values: list[str] | None = None) -> DataFrame:
    """A single reference pivot (``get_*_features``): period + one column per value.

    Only periods with at least one non-null key exist, as in the reference.
    """
    spec = PIVOT_BY_NAME[name]
    partials = period_partials(facts, freq, [spec], with_base=False)
    if values is None:
        partials = _materialise(partials)
        vals = pivot_values_of(partials, [spec])
    else:
        vals = {spec.column: values}
    wide, _ = _widen(partials, [spec], vals, with_base=False)
    return wide


def full_dataset(facts: DataFrame, freq: str = "monthly",
                 pivot_values: dict[str, list[str]] | None = None) -> DataFrame:
    """Base statistics + five pivots, with the pipeline's ``month := date``."""
    return aggregate_periods(facts, freq, pivots=PIVOTS, pivot_values=pivot_values,
                             month_as_date=True)


def drop_partial_last(periods: DataFrame, facts: DataFrame, freq: str, ts_col: str = "order_date") -> DataFrame:
    """``periods`` (a table with ``period``) without the period that the facts don't reach the last day of.

    The last day is one aggregate over one column of the facts, attached as a one-row frame.  No dated
    fact: nothing is complete, and the result is empty."""
    start = period_start_date("period", freq)
    end = {"daily": start, "weekly": F.date_add(start, 6), "monthly": F.last_day(start)}[freq]
    last = facts.agg(F.to_date(F.max(ts_col)).alias("_last_day"))
    return with_scalars(periods, last).where(end <= F.col("_last_day")).drop("_last_day")


def aggregate_monthly(facts: DataFrame) -> DataFrame:
    """A2: monthly A1 with ``year_month`` and ``month := date`` (older callers)."""
    m = aggregate_periods(facts, "monthly")
    return m.withColumns({"year_month": F.col("period"), "month": F.col("date")})


def data_profile(facts: DataFrame) -> DataFrame:
    """Totals, date range, sorted distinct categories / segments, month count."""
    return facts.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.min("order_date").alias("date_start"),
        F.max("order_date").alias("date_end"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.collect_set("customer_segment")).alias("segments"),
        F.countDistinct(period_key("order_date", "monthly")).alias("total_months"),
    )
