"""Period tables of several grains from one scan of the order facts.

Orders are reduced once, to days: sums, counts, squared deviations and customer bitmaps per (day, pivot key,
value, customer bucket), in one shuffle.  That table is written and small; weeks and
months are merged from it, exactly, customers included.  The result has the columns of ``aggregate_periods``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import period_group_key, period_label
from ..params import FREQS
from ..session import materialise
from . import aggregate as agg
from . import distinct

#: measure -> does its sample deviation belong to the table?
MEASURES = {"order_total": True, "quantity": False, "delivery_time_minutes": True, "rating": False}


def _is_base(c: Column) -> Column:
    return F.when(F.col("k") == agg.BASE_KEY, c)


def daily_partials(facts: DataFrame, specs: list[agg.PivotSpec]) -> DataFrame:
    """(day, k, v, id_bucket, order_count, n_/s_/q_ of each measure, id_bits): all that larger grains need."""
    facts = distinct.integer_ids(facts, "customer_id_x")
    base = F.struct(F.lit(agg.BASE_KEY).alias("k"), F.lit(None).cast("string").alias("v"),
                    distinct.bucket_of(F.col("customer_id_x")).alias(distinct.BUCKET))
    entries = [base] + [F.struct(F.lit(sp.column).alias("k"), F.col(sp.column).cast("string").alias("v"),
                                 F.lit(None).cast("long").alias(distinct.BUCKET)) for sp in specs]
    rows = (facts.where(F.col("order_date").isNotNull())
            .select(period_group_key("order_date", "daily").alias("day"), "order_id", "customer_id_x", *MEASURES, F.explode(F.array(*entries)).alias("e"))
            .select("day", "e.*", "order_id", "customer_id_x", *MEASURES)
            .where((F.col("k") == agg.BASE_KEY) | F.col("v").isNotNull()))
    aggs = [F.count("order_id").alias("order_count"), distinct.bits_of(_is_base(F.col("customer_id_x"))).alias(distinct.BITS)]
    for m, deviates in MEASURES.items():
        x = F.col(m) if m == "order_total" else _is_base(F.col(m))
        aggs += [F.count(x).alias(f"n_{m}"), F.sum(x.cast("double")).alias(f"s_{m}")]
        if deviates:
            aggs.append((F.var_pop(x) * F.count(x)).alias(f"q_{m}"))
    return rows.groupBy("day", "k", "v", distinct.BUCKET).agg(*aggs)


def merge_grain(daily: DataFrame, freq: str) -> DataFrame:
    """Partials of one grain as ``aggregate.period_partials`` gives them: (period, k, v, statistics)."""
    at = daily.withColumn("period", period_group_key("day", freq))
    aggs = [F.sum("order_count").alias("order_count")]
    for m, deviates in MEASURES.items():
        aggs += [F.sum(f"n_{m}").alias(f"n_{m}"), F.sum(f"s_{m}").alias(f"s_{m}")]
        if deviates:
            aggs.append(F.sum(F.col(f"q_{m}") + F.try_divide(F.col(f"s_{m}") * F.col(f"s_{m}"), F.col(f"n_{m}"))).alias(f"q_{m}"))

    def mean(m):
        return F.coalesce(F.try_divide(F.col(f"s_{m}"), F.col(f"n_{m}")), F.lit(0.0))

    def deviation(m):
        n, s = F.col(f"n_{m}"), F.col(f"s_{m}")
        return F.coalesce(F.when(n > 1, F.sqrt(F.greatest(F.col(f"q_{m}") - s * s / n, F.lit(0.0)) / (n - 1))), F.lit(0.0))

    whole = at.groupBy("period", "k", "v").agg(*aggs)
    customers = (distinct.count_merged(at.where(F.col("k") == agg.BASE_KEY), ["period"])
                 .select(F.col("period").alias("_p"), F.lit(agg.BASE_KEY).alias("_k"), "n_distinct"))
    joined = whole.join(customers, (F.col("period") == F.col("_p")) & (F.col("k") == F.col("_k")), "left")
    return joined.select(
        period_label(F.col("period"), freq).alias("period"), "k", "v", "order_count", F.coalesce("s_order_total", F.lit(0.0)).alias("total_sales"),
        mean("order_total").alias("avg_order_value"), deviation("order_total").alias("std_order_value"),
        F.coalesce("s_quantity", F.lit(0.0)).alias("total_quantity"), mean("quantity").alias("avg_quantity"),
        F.coalesce("n_distinct", F.lit(0)).alias("unique_customers"), mean("delivery_time_minutes").alias("avg_delivery_time"),
        deviation("delivery_time_minutes").alias("std_delivery_time"), mean("rating").alias("avg_rating"))


def grain_tables(facts: DataFrame, freqs=FREQS, pivots: list[agg.PivotSpec] | None = None, month_as_date: bool = False) -> dict[str, DataFrame]:
    """freq -> period table (A1, and A3-A7 + J1 with ``pivots``); the facts are scanned once for all of them."""
    pivots = pivots or []
    daily = materialise(daily_partials(facts, pivots), "daily-partials")
    values = agg.pivot_values_of(daily, pivots) if pivots else {}
    out = {}
    for freq in freqs:
        wide, names = agg._widen(merge_grain(daily, freq), pivots, values)
        out[freq] = agg.finished(wide, names, freq, month_as_date, bool(pivots))
    return out


def full_datasets(facts: DataFrame, freqs=FREQS) -> dict[str, DataFrame]:
    """J1 at every grain, as ``aggregate.full_dataset`` gives it."""
    return grain_tables(facts, freqs, agg.PIVOTS, month_as_date=True)
