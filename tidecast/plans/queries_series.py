"""Registered queries: window features, sequences, scaling, metrics, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import metrics as met
from ..operators import scaling as sc
from ..operators import sequences as sq
from ..operators import timeseries as ts
from ..params import (MIN_SAMPLES, MIN_WINDOWS_COMPARE, SEQUENCE_FEATURES, SEQUENCE_LENGTH_PRESETS,
                      VALIDATION_SHARE, WORD_LAGS)
from ..functions.calendar import period_group_key, period_label
from ..session import materialise
from ..sources.tables import monthly_sales, order_facts
from .registry import comparable, register
from .sql_blocks import cast_wrap, period_table_sql, with_facts

FREQ_ORDER = ("daily", "weekly", "monthly")


def periods(spark, sf_dir, freq="monthly") -> DataFrame:
    return agg.aggregate_periods(order_facts(spark, sf_dir, category=False, segment=False), freq)


def written_periods(spark, sf_dir) -> DataFrame:
    """The monthly period table, written once: what needs it twice scans the facts once."""
    return materialise(periods(spark, sf_dir), "periods")


def pt_sql(body: str, freq: str = "monthly", extra: str = "") -> str:
    """Body over the CTE ``pt`` (period table, doubles uncast, dates as DATE)."""
    ctes = "pt AS (" + period_table_sql(freq, pivots=False, month_as_date=False, cast=False) + ")"
    return with_facts(body, ctes + (",\n" + extra if extra else ""))


# --- W1: lags left NULL ---------------------------------------------------------
_LAGS = [1, 2, 3, 6]


@register("lag_features", cast_wrap(pt_sql(
    "SELECT period, total_sales, " + ", ".join(
        f"lag(total_sales, {k}) OVER (ORDER BY period) AS total_sales_lag_{k}" for k in _LAGS)
    + " FROM pt"), ["total_sales"] + [f"total_sales_lag_{k}" for k in _LAGS]))
def lag_features(spark, sf_dir):
    p = periods(spark, sf_dir).select("period", "total_sales")
    return comparable(ts.add_lags(p, "total_sales", _LAGS))


# --- W2: lags of the monthly sales series, filled with 0 at once -----------------
@register("lag_features_filled", cast_wrap("""
WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS sales
           FROM orders GROUP BY 1)
SELECT month, sales, """ + ", ".join(
    f"coalesce(lag(sales, {k}) OVER (ORDER BY month), 0) AS sales_lag_{k}" for k in WORD_LAGS)
    + " FROM s", ["sales"] + [f"sales_lag_{k}" for k in WORD_LAGS], ["month"]))
def lag_features_filled(spark, sf_dir):
    s = monthly_sales(spark, sf_dir)
    return comparable(ts.add_lags(s, "sales", WORD_LAGS, order_col="month", fill=0.0))


# --- W4: rolling statistics, NULL until the window is full ------------------------
_WINDOWS = [2, 3, 6]


def _rolling_sql():
    cols = []
    for k in _WINDOWS:
        fr = f"(ORDER BY period ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        gate = f"count(total_sales) OVER {fr} = {k}"
        for stat, fn in (("ma", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            cols.append((f"total_sales_{stat}_{k}", f"CASE WHEN {gate} THEN {fn}(total_sales) OVER {fr} END"))
    body = "SELECT period, total_sales, " + ", ".join(f"{e} AS {n}" for n, e in cols) + " FROM pt"
    return cast_wrap(pt_sql(body), ["total_sales"] + [n for n, _ in cols])


@register("rolling_features", _rolling_sql())
def rolling_features(spark, sf_dir):
    p = periods(spark, sf_dir).select("period", "total_sales")
    return comparable(ts.add_rolling(p, "total_sales", _WINDOWS))


# --- W7: trailing partial-window statistics (population std) ----------------------
@register("trailing_stats", cast_wrap(pt_sql("""
SELECT period, total_sales,
  avg(total_sales) OVER w AS total_sales_tmean_3,
  coalesce(stddev_pop(total_sales) OVER w, 0) AS total_sales_tstd_3,
  min(total_sales) OVER w AS total_sales_tmin_3,
  max(total_sales) OVER w AS total_sales_tmax_3
FROM pt WINDOW w AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""),
    ["total_sales", "total_sales_tmean_3", "total_sales_tstd_3", "total_sales_tmin_3",
     "total_sales_tmax_3"]))
def trailing_stats(spark, sf_dir):
    p = periods(spark, sf_dir).select("period", "total_sales")
    return comparable(ts.trailing_stats(p, "total_sales", 3))


# --- W6: growth -------------------------------------------------------------------
_GROWTH_SQL = """
SELECT {keys}period, total_sales,
  coalesce(total_sales / NULLIF(lag(total_sales, 1) OVER w, 0) - 1, 0) AS total_sales_mom_growth,
  CASE WHEN count(*) OVER ({part}) > 12
       THEN coalesce(total_sales / NULLIF(lag(total_sales, 12) OVER w, 0) - 1, 0) ELSE 0 END
    AS total_sales_yoy_growth{lags}
FROM {src} WINDOW w AS ({part} ORDER BY period)"""


@register("growth_features", cast_wrap(pt_sql(_GROWTH_SQL.format(keys="", part="", lags="", src="pt")),
                                       ["total_sales", "total_sales_mom_growth", "total_sales_yoy_growth"]))
def growth_features(spark, sf_dir):
    p = periods(spark, sf_dir).select("period", "total_sales")
    return comparable(ts.add_growth(p, "total_sales"))


_CAT_LAGS = [1, 2, 3]


@register("growth_by_category", cast_wrap(with_facts(_GROWTH_SQL.format(
    keys="category, ", part="PARTITION BY category",
    lags="".join(f", coalesce(lag(total_sales, {k}) OVER w, 0) AS total_sales_lag_{k}" for k in _CAT_LAGS),
    src="cs"), "cs AS (SELECT category, strftime(order_date, '%Y-%m') AS period, "
               "sum(order_total) AS total_sales FROM facts WHERE category IS NOT NULL "
               "AND order_date IS NOT NULL GROUP BY 1, 2)"),
    ["total_sales", "total_sales_mom_growth", "total_sales_yoy_growth"]
    + [f"total_sales_lag_{k}" for k in _CAT_LAGS]))
def growth_by_category(spark, sf_dir):
    """W1 + W6 per category series: the window partitions by the series key."""
    from ..functions.calendar import period_key
    facts = order_facts(spark, sf_dir)
    cs = (facts.where(F.col("category").isNotNull() & F.col("order_date").isNotNull())
          .groupBy("category", period_key("order_date", "monthly").alias("period"))
          .agg(F.sum("order_total").alias("total_sales")))
    out = ts.add_lags(cs, "total_sales", _CAT_LAGS, series_keys=["category"])
    return comparable(ts.add_growth(out, "total_sales", series_keys=["category"]))


# --- W8/W9: sequence windows, long view --------------------------------------------
_L = SEQUENCE_LENGTH_PRESETS["monthly"]


def _seq_long_sql():
    feats = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SEQUENCE_FEATURES)
    body = f"""
SELECT r.period, CAST(s.rn - r.rn + {_L + 1} AS INTEGER) AS step, u.feature, CAST(u.value AS FLOAT) AS value
FROM t r JOIN t s ON s.rn BETWEEN r.rn - {_L} AND r.rn - 1
JOIN (UNPIVOT (SELECT rn, {', '.join(SEQUENCE_FEATURES)} FROM t)
      ON {', '.join(SEQUENCE_FEATURES)} INTO NAME feature VALUE value) u
  ON u.rn = s.rn
WHERE r.rn > {_L}"""
    return pt_sql(body, extra=f"t AS (SELECT period, {feats}, row_number() OVER (ORDER BY period) AS rn FROM pt)")


@register("sequences_monthly", _seq_long_sql())
def sequences_monthly(spark, sf_dir):
    p = periods(spark, sf_dir)
    seq = sq.build_sequences(p, SEQUENCE_FEATURES, "total_sales", _L)
    long = sq.sequences_long(seq, SEQUENCE_FEATURES)
    return comparable(long.withColumn("step", F.col("step").cast("int")))


@register("last_training_window", f"SELECT * FROM ({_seq_long_sql()}) q WHERE period = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders)")
def last_training_window(spark, sf_dir):
    """D4, for parity: the window that the reference forecasts from; its target is the last observed month."""
    seq = sq.build_sequences(periods(spark, sf_dir), SEQUENCE_FEATURES, "total_sales", _L)
    long = sq.sequences_long(sq.last_training_window(seq), SEQUENCE_FEATURES)
    return comparable(long.withColumn("step", F.col("step").cast("int")))


@register("sequence_targets", cast_wrap(pt_sql(f"""
SELECT period, total_sales AS y,
  lag(CAST(order_count AS DOUBLE), 1) OVER w AS last_order_count,
  lag(total_sales, 1) OVER w AS last_total_sales
FROM pt WINDOW w AS (ORDER BY period) QUALIFY row_number() OVER w > {_L}"""),
    ["y", "last_order_count", "last_total_sales"]))
def sequence_targets(spark, sf_dir):
    """W9 targets and W11 (last-timestep features) of every window."""
    p = periods(spark, sf_dir)
    seq = sq.build_sequences(p, SEQUENCE_FEATURES, "total_sales", _L)
    return comparable(seq.select("period", "y", F.col("x_last")[0].alias("last_order_count"),
                                 F.col("x_last")[1].alias("last_total_sales")))


# --- W12: chronological split --------------------------------------------------------
@register("chrono_split", pt_sql(f"""
SELECT period, CASE WHEN row_number() OVER (ORDER BY period)
                         <= floor(count(*) OVER () * {1.0 - VALIDATION_SHARE}) THEN 'train'
                    ELSE 'validation' END AS split
FROM pt"""))
def chrono_split(spark, sf_dir):
    p = periods(spark, sf_dir).select("period")
    return comparable(ts.chrono_split(p, VALIDATION_SHARE))


# --- M3: z-score fitted on the training prefix ---------------------------------------
def _split_cte():
    return (f"sp AS (SELECT *, row_number() OVER (ORDER BY period) <= floor(count(*) OVER () * "
            f"{1.0 - VALIDATION_SHARE}) AS is_train FROM pt)")


def _std_sql():
    stats = ", ".join(f"avg({c}) AS m_{c}, coalesce(NULLIF(stddev_pop({c}), 0), 1) AS s_{c}"
                      for c in SEQUENCE_FEATURES)
    z = ", ".join(f"CAST(({c} - m_{c}) / s_{c} AS FLOAT) AS {c}_z" for c in SEQUENCE_FEATURES)
    return pt_sql(f"SELECT period, is_train, {z} FROM sp, st",
                  extra=_split_cte() + f",\nst AS (SELECT {stats} FROM sp WHERE is_train)")


@register("standard_scale", _std_sql())
def standard_scale(spark, sf_dir):
    p = ts.chrono_split(written_periods(spark, sf_dir), VALIDATION_SHARE).withColumn("is_train", F.col("split") == "train")
    stats = sc.standard_stats(p.where("is_train"), SEQUENCE_FEATURES)
    scaled = sc.standard_scaled(p, stats, SEQUENCE_FEATURES)
    return comparable(scaled.select("period", "is_train", *[f"{c}_z" for c in SEQUENCE_FEATURES]))


# --- M3 pooled over the timesteps of the training windows ---------------------------
def _seq_std_sql():
    base = _seq_long_sql()
    return f"""
WITH lng AS ({base.replace('CAST(u.value AS FLOAT) AS value', 'u.value AS value')}),
w AS (SELECT *, dense_rank() OVER (ORDER BY period) AS wn, count(DISTINCT period) OVER () AS nw FROM lng),
tr AS (SELECT * FROM w WHERE wn <= floor(nw * {1.0 - VALIDATION_SHARE})),
st AS (SELECT feature, avg(value) AS m, coalesce(NULLIF(stddev_pop(value), 0), 1) AS s FROM tr GROUP BY feature)
SELECT lng.period, lng.step, lng.feature, CAST((lng.value - st.m) / st.s AS FLOAT) AS value_z
FROM lng JOIN st USING (feature)"""


@register("standard_scale_sequences", _seq_std_sql())
def standard_scale_sequences(spark, sf_dir):
    """Pooled statistics: each feature over every timestep of every training window, a row counted as often as windows hold it."""
    p = sc.window_weights(written_periods(spark, sf_dir), _L, VALIDATION_SHARE)
    scaled = sc.standard_scaled(p, sc.standard_stats(p, SEQUENCE_FEATURES, weight="weight"), SEQUENCE_FEATURES)
    z = scaled.select("period", "total_sales", *[F.col(f"{c}_z").alias(f"_{c}") for c in SEQUENCE_FEATURES])
    long = sq.sequences_long(sq.build_sequences(z, [f"_{c}" for c in SEQUENCE_FEATURES], "total_sales", _L), SEQUENCE_FEATURES)
    return comparable(long.select("period", F.col("step").cast("int").alias("step"), "feature", F.col("value").alias("value_z")))


# --- M4/M5: min-max target scaling and its inverse --------------------------------
@register("minmax_scale_roundtrip", cast_wrap(pt_sql("""
SELECT period, total_sales,
       (total_sales - lo) / coalesce(NULLIF(hi - lo, 0), 1) AS sales_scaled,
       ((total_sales - lo) / coalesce(NULLIF(hi - lo, 0), 1)) * coalesce(NULLIF(hi - lo, 0), 1) + lo
         AS sales_restored
FROM pt, (SELECT min(total_sales) AS lo, max(total_sales) AS hi FROM pt) mm"""),
    ["total_sales", "sales_scaled", "sales_restored"]))
def minmax_scale_roundtrip(spark, sf_dir):
    p = written_periods(spark, sf_dir).select("period", "total_sales")
    scaled = sc.minmax_scaled(p, sc.minmax_stats(p, ["total_sales"]), ["total_sales"])
    return comparable(scaled.select("period", "total_sales", F.col("total_sales_scaled").alias("sales_scaled"),
                                    sc.minmax_restored(F.col("total_sales_scaled"), "total_sales").alias("sales_restored")))


# --- A11 / E4: naive (lag-1) forecast over the model's windows ------------------------
def naive_forecast(p: DataFrame, length: int, target: str = "total_sales") -> DataFrame:
    """y = target of row i, y_pred = target of row i-1, for windows i >= L."""
    w = ts.series_window("period")
    return (p.select("period", F.col(target).cast("double").alias("y"),
                     F.lag(F.col(target).cast("double"), 1).over(w).alias("y_pred"),
                     F.row_number().over(w).alias("rn"))
            .where(F.col("rn") > length).drop("rn"))


def _naive_cte(freq, length):
    return (f"nf AS (SELECT period, y, y_pred FROM (SELECT period, CAST(total_sales AS DOUBLE) AS y, "
            f"lag(CAST(total_sales AS DOUBLE), 1) OVER (ORDER BY period) AS y_pred, "
            f"row_number() OVER (ORDER BY period) AS rn FROM pt) x WHERE rn > {length})")


_METRICS_SQL = """count(*) AS n_samples, avg(abs(y - y_pred)) AS MAE, avg((y - y_pred) * (y - y_pred)) AS MSE,
  sqrt(avg((y - y_pred) * (y - y_pred))) AS RMSE,
  CASE WHEN var_pop(y) * count(y) = 0 THEN CASE WHEN sum((y - y_pred) * (y - y_pred)) = 0 THEN 1.0 ELSE 0.0 END
       ELSE 1 - sum((y - y_pred) * (y - y_pred)) / (var_pop(y) * count(y)) END AS R2,
  coalesce(avg(CASE WHEN y <> 0 THEN abs((y - y_pred) / y) END) * 100, 0) AS MAPE"""
_METRIC_COLS = ["MAE", "MSE", "RMSE", "R2", "MAPE"]


@register("forecast_metrics_naive", cast_wrap(pt_sql(f"SELECT {_METRICS_SQL} FROM nf",
                                                     extra=_naive_cte("monthly", _L)), _METRIC_COLS))
def forecast_metrics_naive(spark, sf_dir):
    nf = naive_forecast(periods(spark, sf_dir), _L)
    return comparable(met.regression_metrics(nf))


@register("forecast_residuals", cast_wrap(pt_sql(
    "SELECT period, y, y_pred, y - y_pred AS residual, abs((y - y_pred) / NULLIF(y, 0)) * 100 AS abs_pct_error "
    "FROM nf", extra=_naive_cte("monthly", _L)), ["y", "y_pred", "residual", "abs_pct_error"]))
def forecast_residuals(spark, sf_dir):
    nf = naive_forecast(periods(spark, sf_dir), _L)
    return comparable(met.residuals(nf))


@register("residual_summary", cast_wrap(pt_sql("""
SELECT bin, count(*) AS n, median_ape
FROM (SELECT least(CAST(floor((ape - lo) / CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1 END) AS BIGINT) + 1, 20) AS bin,
             median_ape
      FROM (SELECT abs((y - y_pred) / NULLIF(y, 0)) * 100 AS ape FROM nf) r,
           (SELECT min(abs((y - y_pred) / NULLIF(y, 0)) * 100) AS lo, max(abs((y - y_pred) / NULLIF(y, 0)) * 100) AS hi,
                   quantile_cont(abs((y - y_pred) / NULLIF(y, 0)) * 100, 0.5) AS median_ape FROM nf) s
      WHERE ape IS NOT NULL) b
GROUP BY bin, median_ape""", extra=_naive_cte("monthly", _L)), ["median_ape"]))
def residual_summary(spark, sf_dir):
    """20-bin histogram of absolute % errors and their median."""
    hist = met.residual_histogram(met.residuals(naive_forecast(written_periods(spark, sf_dir), _L)), "abs_pct_error", 20)
    return comparable(hist.select(F.col("bin").cast("bigint").alias("bin"), "n", F.col("median").alias("median_ape")))


# --- M18 / A13 / PF11 / PF12: comparison across grains ----------------------------------
def grain_totals(spark, sf_dir) -> dict[str, DataFrame]:
    """(period, total_sales) per grain from one scan: days are summed once and rolled up."""
    facts = order_facts(spark, sf_dir, category=False, segment=False).where(F.col("order_date").isNotNull())
    days = materialise(facts.groupBy(F.to_date("order_date").alias("day")).agg(F.sum("order_total").alias("total")), "day-totals")
    return {freq: (days.groupBy(period_group_key("day", freq).alias("k"))
                   .agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total_sales"))
                   .select(period_label(F.col("k"), freq).alias("period"), "total_sales")) for freq in FREQ_ORDER}


def compare_frame(spark, sf_dir) -> DataFrame:
    totals = grain_totals(spark, sf_dir)
    parts = []
    for i, freq in enumerate(FREQ_ORDER):
        p = totals[freq]
        nf = naive_forecast(p, SEQUENCE_LENGTH_PRESETS[freq])
        m = met.regression_metrics(nf).select(F.lit(freq).alias("freq"), F.lit(i).alias("ord"), "*")
        parts.append(m)
    allm = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ok = F.col("n_samples") >= MIN_WINDOWS_COMPARE
    allm = allm.withColumn("status", F.when(ok, F.lit("success")).otherwise(F.lit("insufficient_data")))
    for c in _METRIC_COLS:
        allm = allm.withColumn(c, F.when(ok, F.col(c)))
    # Three rows (one per grain): a whole-frame window is the natural argmax here.
    best = F.min_by(F.when(F.col("status") == "success", F.col("freq")),
                    F.when(F.col("status") == "success", F.struct(-F.col("R2"), F.col("ord"))))
    return allm.withColumn("is_best", F.coalesce(
        F.col("freq") == best.over(Window.partitionBy()), F.lit(False)))


def _compare_sql():
    parts = []
    for i, freq in enumerate(FREQ_ORDER):
        L = SEQUENCE_LENGTH_PRESETS[freq]
        pt = period_table_sql(freq, pivots=False, month_as_date=False, cast=False)
        parts.append(f"""SELECT '{freq}' AS freq, {i} AS ord, {_METRICS_SQL}
FROM (SELECT y, y_pred FROM (SELECT CAST(total_sales AS DOUBLE) AS y,
        lag(CAST(total_sales AS DOUBLE), 1) OVER (ORDER BY period) AS y_pred,
        row_number() OVER (ORDER BY period) AS rn FROM ({pt}) p) x WHERE rn > {L}) nf""")
    ctes = f"""m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT freq, CAST(ord AS INTEGER) AS ord, n_samples,
             CASE WHEN n_samples >= {MIN_WINDOWS_COMPARE} THEN 'success' ELSE 'insufficient_data' END AS status,
             {', '.join(f"CASE WHEN n_samples >= {MIN_WINDOWS_COMPARE} THEN {c} END AS {c}" for c in _METRIC_COLS)}
      FROM m),
b AS (SELECT arg_min(freq, (-R2, ord)) AS best FROM s WHERE status = 'success')"""
    body = "SELECT s.*, coalesce(s.freq = b.best, false) AS is_best FROM s LEFT JOIN b ON true"
    return cast_wrap(with_facts(body, ctes), _METRIC_COLS)


@register("compare_frequencies", _compare_sql())
def compare_frequencies(spark, sf_dir):
    return comparable(compare_frame(spark, sf_dir))


# --- W13 / W14: next-period change ---------------------------------------------------
def next_period_frame(spark, sf_dir, k: int = 3) -> DataFrame:
    """Per grain: last period, last value, mean of the last k values as the
    reference-line prediction, and the change percent against the last value."""
    totals = grain_totals(spark, sf_dir)
    out = []
    for freq in FREQ_ORDER:
        p = totals[freq].select(
            F.col("period").cast("string").alias("period"), "total_sales")
        w = ts.series_window("period")
        p = p.withColumn("pred", F.avg("total_sales").over(w.rowsBetween(-(k - 1), 0)))
        last = p.agg(F.max("period").alias("last_period"),
                     F.max_by("total_sales", "period").alias("last_value"),
                     F.max_by("pred", "period").alias("predicted_value"))
        out.append(last.select(F.lit(freq).alias("freq"), "*"))
    res = out[0].unionByName(out[1]).unionByName(out[2])
    return res.withColumn("change_percent", ts.change_percent(F.col("predicted_value"), F.col("last_value")))


def _next_sql():
    parts = []
    for freq in FREQ_ORDER:
        pt = period_table_sql(freq, pivots=False, month_as_date=False, cast=False)
        parts.append(f"""SELECT '{freq}' AS freq, max(period) AS last_period, arg_max(total_sales, period) AS last_value,
  arg_max(pred, period) AS predicted_value
FROM (SELECT CAST(period AS VARCHAR) AS period, total_sales,
             avg(total_sales) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS pred
      FROM ({pt}) p) x""")
    body = (f"SELECT *, coalesce((predicted_value - last_value) / NULLIF(last_value, 0) * 100, 0) AS change_percent "
            f"FROM ({' UNION ALL '.join(parts)}) u")
    return cast_wrap(with_facts(body), ["last_value", "predicted_value", "change_percent"])


@register("next_period_change", _next_sql())
def next_period_change(spark, sf_dir):
    return comparable(next_period_frame(spark, sf_dir))


# --- A8 / PF12 ---------------------------------------------------------------------
@register("data_profile", with_facts("""
SELECT count(*) AS total_orders, CAST(min(order_date) AS VARCHAR) AS date_start,
       CAST(max(order_date) AS VARCHAR) AS date_end,
       array_to_string(list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)), '|') AS categories,
       array_to_string(list_sort(list(DISTINCT customer_segment) FILTER (WHERE customer_segment IS NOT NULL)), '|') AS segments,
       count(DISTINCT strftime(order_date, '%Y-%m')) AS total_months
FROM facts"""))
def data_profile(spark, sf_dir):
    prof = agg.data_profile(order_facts(spark, sf_dir))
    return comparable(prof.withColumns({"categories": F.array_join("categories", "|"),
                                        "segments": F.array_join("segments", "|")}))


@register("sufficiency_gate", with_facts(f"""
SELECT CAST(count(DISTINCT strftime(order_date, '%Y-%m')) AS BIGINT) AS n_periods,
       CASE WHEN count(DISTINCT strftime(order_date, '%Y-%m')) - {_L} >= {MIN_SAMPLES} THEN 'success'
            ELSE 'insufficient_data' END AS status
FROM facts WHERE order_date IS NOT NULL"""))
def sufficiency_gate(spark, sf_dir):
    """PF12: a run needs at least MIN_SAMPLES windows (periods - L)."""
    p = periods(spark, sf_dir)
    n = p.agg(F.count(F.lit(1)).alias("n_periods"))
    return n.withColumn("status", F.when(F.col("n_periods") - _L >= MIN_SAMPLES, F.lit("success"))
                        .otherwise(F.lit("insufficient_data")))
