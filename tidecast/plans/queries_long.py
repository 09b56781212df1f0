"""Registered queries: window features over series of raw rows, which no calendar bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import long_series as ls
from ..params import VALIDATION_SHARE
from ..sources.tables import table
from .registry import comparable, register

_LAGS, _WINDOWS = [1, 2, 7], [3, 6]


def _features_sql(part, where=""):
    cols = [f"coalesce(lag(q, {k}) OVER w, 0) AS q_lag_{k}" for k in _LAGS]
    for k in _WINDOWS:
        frame = f"({part} ORDER BY o, n, q ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        for name, fn in (("ma", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            value = f"CASE WHEN count(q) OVER {frame} = {k} THEN {fn}(q) OVER {frame} END"
            cols.append(f"round(coalesce({value}, 0), 6) + 0.0 AS q_{name}_{k}")
    last = f"({part} ORDER BY o, n, q ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    cols += [f"round(coalesce(stddev_pop(q) OVER {last}, 0), 6) + 0.0 AS q_tstd_3", f"round(avg(q) OVER {last}, 6) + 0.0 AS q_tmean_3"]
    cols += [f"round(coalesce(q / NULLIF(lag(q, {k}) OVER w, 0) - 1, 0), 6) + 0.0 AS q_{name}_growth" for k, name in ((1, "mom"), (12, "yoy"))]
    names = ["q", *[c.rsplit(" AS ", 1)[1] for c in cols]]
    return f"""
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_returnflag AS m, CAST(l_quantity AS DOUBLE) AS q FROM lineitem{where}),
f AS (SELECT o, n, q, {', '.join(cols)} FROM l WINDOW w AS ({part} ORDER BY o, n, q))
SELECT o AS l_orderkey, n AS l_linenumber, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in names)} FROM f"""


def _features(spark, sf_dir, series_keys):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("q"))
    out = ls.add_time_series_features(lines, "q", _LAGS, _WINDOWS, trailing=3, order_col="l_orderkey", tie_cols=["l_linenumber", "q"],
                                      series_keys=series_keys)
    kept = [c for c in out.columns if c.startswith("q_") and c not in ("q_tmin_3", "q_tmax_3")]
    return comparable(out.select("l_orderkey", "l_linenumber", "q", *[(F.round(c, 6) + 0.0).alias(c) for c in kept]))


@register("long_series_features", _features_sql(""))
def long_series_features(spark, sf_dir):
    """W1, W4, W6, W7 with every line of ``lineitem`` as ONE series."""
    return _features(spark, sf_dir, [])


@register("long_series_by_key", _features_sql("PARTITION BY m"))
def long_series_by_key(spark, sf_dir):
    """The same with one series per return flag; any of them may hold any share of the rows."""
    return _features(spark, sf_dir, ["l_returnflag"])


@register("long_series_split", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber)
       <= floor(count(*) OVER (PARTITION BY l_returnflag) * {1.0 - VALIDATION_SHARE}) THEN 'train' ELSE 'validation' END AS split
FROM lineitem""")
def long_series_split(spark, sf_dir):
    """W12 per return flag over all lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return ls.chrono_split(lines, VALIDATION_SHARE, order_col="l_orderkey", tie_cols=["l_linenumber"],
                           series_keys=["l_returnflag"]).select("l_orderkey", "l_linenumber", "split")
