"""Registered queries over the order facts: period tables, pivots, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import grains
from ..operators import timeseries as ts
from ..params import FREQS, LAG_PRESETS, ROLLING_PRESETS
from ..sources.tables import order_facts
from .registry import comparable, register
from .sql_blocks import cast_wrap, date_sql, period_sql, period_table_sql, with_facts


def _period_sql(freq):
    return with_facts(period_table_sql(freq, pivots=False, month_as_date=False))


def _period_query(freq):
    def q(spark, sf_dir):
        return comparable(agg.aggregate_periods(order_facts(spark, sf_dir, category=False, segment=False), freq))
    return q


for _freq in ("monthly", "weekly", "daily"):
    register(f"period_agg_{_freq}", _period_sql(_freq))(_period_query(_freq))


def _grains_sql():
    names = ", ".join(agg.BASE_COLUMNS)
    parts = [f"SELECT '{f}' AS freq, CAST(period AS VARCHAR) AS period, {names} FROM ({period_table_sql(f, pivots=False, month_as_date=False)}) p"
             for f in FREQS]
    return with_facts(" UNION ALL ".join(parts))


@register("grains_one_scan", _grains_sql())
def grains_one_scan(spark, sf_dir):
    """A1 + PF1: three grains merged from one table of days, with exact distinct customers."""
    tables = grains.grain_tables(order_facts(spark, sf_dir, category=False, segment=False))
    out = [t.select(F.lit(f).alias("freq"), F.col("period").cast("string").alias("period"), *agg.BASE_COLUMNS) for f, t in tables.items()]
    return comparable(out[0].unionByName(out[1]).unionByName(out[2]))


# --- calendar features (F1-F3) ------------------------------------------------
from ..functions.calendar import calendar_columns, cyclic_time_columns  # noqa: E402

_CAL_SQL = with_facts("""
SELECT CAST(d AS VARCHAR) AS date,
       CAST(isodow(d) - 1 AS BIGINT) AS day_of_week,
       CAST(weekofyear(d) AS BIGINT) AS week_of_year,
       CAST(month(d) AS BIGINT) AS month_num,
       CAST(quarter(d) AS BIGINT) AS quarter,
       CAST(year(d) AS BIGINT) AS year,
       CAST(sin(2 * pi() * month(d) / 12) AS FLOAT) AS month_sin,
       CAST(cos(2 * pi() * month(d) / 12) AS FLOAT) AS month_cos,
       CAST(sin(2 * pi() * quarter(d) / 4) AS FLOAT) AS quarter_sin,
       CAST(cos(2 * pi() * quarter(d) / 4) AS FLOAT) AS quarter_cos
FROM (SELECT DISTINCT CAST(order_date AS DATE) AS d FROM facts WHERE order_date IS NOT NULL) t""")


@register("calendar_features", _CAL_SQL)
def calendar_features(spark, sf_dir):
    days = (order_facts(spark, sf_dir).where(F.col("order_date").isNotNull())
            .select(F.to_date("order_date").alias("date")).distinct())
    cal = calendar_columns("date")
    cyc = cyclic_time_columns("date")
    return comparable(days.select(
        "date", cal["day_of_week"].alias("day_of_week"), cal["week_of_year"].alias("week_of_year"),
        *[c.alias(n) for n, c in cyc.items()]))


# --- single pivots (A3-A7) ----------------------------------------------------
def _pivot_sql(name):
    spec = agg.PIVOT_BY_NAME[name]
    from .sql_blocks import pivot_sql_columns
    cols = pivot_sql_columns([spec], cast=True)
    sel = ", ".join(f'{e} AS "{n}"' for n, e in cols)
    return with_facts(f"SELECT {period_sql('monthly')} AS period, {sel} FROM facts "
                      f"WHERE order_date IS NOT NULL AND {spec.column} IS NOT NULL GROUP BY 1")


def _pivot_query(name):
    def q(spark, sf_dir):
        return comparable(agg.pivot_table(order_facts(spark, sf_dir, category=name == "category", segment=name == "segment"), name, "monthly"))
    return q


for _name in ("category", "segment", "delivery", "sentiment", "payment"):
    register(f"pivot_{_name}", _pivot_sql(_name))(_pivot_query(_name))


# --- full dataset (J1) and the flagship feature table ---------------------------
register("full_dataset_monthly",
         with_facts(period_table_sql("monthly", pivots=True, month_as_date=True)))(
    lambda spark, sf_dir: comparable(agg.full_dataset(order_facts(spark, sf_dir), "monthly")))


def feature_table(spark, sf_dir, freq="monthly", target="total_sales"):
    """Reference pipeline stage 1: J1 + W1 + W4 + W6 (what the processed CSV holds)."""
    full = agg.full_dataset(order_facts(spark, sf_dir), freq)
    return ts.add_time_series_features(full, target, LAG_PRESETS[freq], ROLLING_PRESETS[freq])


def feature_sql_columns(target: str, lags, windows, series_keys=(), order="period"):
    """(name, SQL) of the W1 + W4 + W6 columns after the final fill."""
    part = f"PARTITION BY {', '.join(series_keys)} " if series_keys else ""
    w = f"({part}ORDER BY {order})"
    cols = []
    for k in lags:
        cols.append((f"{target}_lag_{k}", f"coalesce(lag({target}, {k}) OVER {w}, 0)"))
    for k in windows:
        fr = f"({part}ORDER BY {order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        gate = f"count({target}) OVER {fr} = {k}"
        for stat, fn in (("ma", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            cols.append((f"{target}_{stat}_{k}",
                         f"coalesce(CASE WHEN {gate} THEN {fn}({target}) OVER {fr} END, 0)"))
    cols.append((f"{target}_mom_growth",
                 f"coalesce({target} / NULLIF(lag({target}, 1) OVER {w}, 0) - 1, 0)"))
    cols.append((f"{target}_yoy_growth",
                 f"CASE WHEN count(*) OVER ({part.strip()}) > 12 THEN "
                 f"coalesce({target} / NULLIF(lag({target}, 12) OVER {w}, 0) - 1, 0) ELSE 0 END"))
    return cols


def _flagship_sql(freq="monthly"):
    from .sql_blocks import BASE_AGG_SQL, pivot_sql_columns
    feats = feature_sql_columns("total_sales", LAG_PRESETS[freq], ROLLING_PRESETS[freq])
    body = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in feats) + " FROM full_t"
    sql = with_facts(body, extra_ctes="full_t AS (" + period_table_sql(
        freq, pivots=True, month_as_date=True, cast=False) + ")")
    doubles = ([n for n, _, dbl in BASE_AGG_SQL if dbl] + [n for n, _ in pivot_sql_columns()]
               + [n for n, _ in feats])
    dates = ["date", "month"] if freq == "monthly" else ["period", "date", "month"]
    return cast_wrap(sql, doubles, dates)


@register("features_monthly", _flagship_sql())
def features_monthly(spark, sf_dir):
    return comparable(feature_table(spark, sf_dir, "monthly"))


def _features_query(freq):
    def q(spark, sf_dir):
        return comparable(feature_table(spark, sf_dir, freq))
    return q


for _freq in ("weekly", "daily"):
    register(f"features_{_freq}", _flagship_sql(_freq))(_features_query(_freq))


# --- SNK1 -> SRC1 round trip -------------------------------------------------------
@register("orders_csv_roundtrip", _period_sql("monthly"))
def orders_csv_roundtrip(spark, sf_dir):
    """Order facts written as an order CSV with its columns reversed and one
    more in front, read back by name with the typed CSV source (SRC1), then aggregated monthly."""
    from ..session import scratch_path
    from ..sources.files import load_orders_csv
    path = scratch_path(spark, "orders-csv")
    facts = order_facts(spark, sf_dir)
    facts = facts.select(F.lit("x").alias("warehouse"), *reversed(facts.columns))
    facts.write.mode("overwrite").option("header", True).csv(path)
    return comparable(agg.aggregate_periods(load_orders_csv(spark, path), "monthly"))


def _complete_sql():
    last = {"daily": "start", "weekly": "start + 6", "monthly": "last_day(start)"}
    parts = [f"SELECT '{freq}' AS freq, CAST(period AS VARCHAR) AS period, order_count, CAST(total_sales AS FLOAT) AS total_sales "
             f"FROM (SELECT *, {date_sql(freq)} AS start FROM ({period_table_sql(freq, pivots=False, month_as_date=False, cast=False)}) p) t "
             f"WHERE {last[freq]} <= (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)" for freq in FREQS]
    return with_facts(" UNION ALL ".join(parts))


@register("complete_periods", _complete_sql())
def complete_periods(spark, sf_dir):
    """Every grain's periods without a last one that the orders don't reach the end of."""
    facts = order_facts(spark, sf_dir, category=False, segment=False)
    tables = [agg.drop_partial_last(agg.aggregate_periods(facts, freq), facts, freq)
              .select(F.lit(freq).alias("freq"), F.col("period").cast("string").alias("period"), "order_count", "total_sales") for freq in FREQS]
    return comparable(tables[0].unionByName(tables[1]).unionByName(tables[2]))
