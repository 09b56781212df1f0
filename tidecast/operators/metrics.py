"""Forecast evaluation.

Spark ML's ``RegressionEvaluator`` neither masks zero targets for MAPE nor
follows scikit-learn's R2 rule for a constant target, so the metrics are one
aggregation (per group, partial aggregation before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import with_scalars


def metric_aggregates(y: str = "y", yhat: str = "y_pred") -> list[Column]:
    e = F.col(y) - F.col(yhat)
    sse = F.sum(e * e)
    sst = F.var_pop(F.col(y)) * F.count(F.col(y))
    r2 = (F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - sse / sst))
    mape = F.coalesce(F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))) * F.lit(100.0), F.lit(0.0))
    return [F.avg(F.abs(e)).alias("MAE"), F.avg(e * e).alias("MSE"),
            F.sqrt(F.avg(e * e)).alias("RMSE"), r2.alias("R2"), mape.alias("MAPE")]


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "y_pred", group_cols=()) -> DataFrame:
    """MAE, MSE, RMSE, R2 (constant y: 1 if perfect else 0), MAPE % over y != 0."""
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n_samples"), *metric_aggregates(y, yhat))


def residuals(df: DataFrame, y: str = "y", yhat: str = "y_pred") -> DataFrame:
    """Residual and absolute percentage error (NULL where y = 0)."""
    return df.withColumns({
        "residual": F.col(y) - F.col(yhat),
        "abs_pct_error": F.abs(F.try_divide(F.col(y) - F.col(yhat), F.col(y))) * F.lit(100.0),
    })


def residual_histogram(res: DataFrame, col: str = "abs_pct_error", bins: int = 20) -> DataFrame:
    """Equal-width histogram (numpy convention: the maximum falls in the last bin) and the median:
    bin, n, bin_lo, bin_hi, median; empty without values.  The bounds are a one-row aggregate
    attached to ``res``: two passes, so hand in a written table where ``res`` is dear."""
    x, filled = F.col(col), res.where(F.col(col).isNotNull())
    bounds = filled.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.percentile(x, 0.5).alias("median"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(F.lit(1.0))
    idx = F.least(F.floor((x - F.col("_lo")) / F.col("_width")) + 1, F.lit(bins)).cast("int")
    placed = with_scalars(filled.select(col), bounds.withColumn("_width", width)).withColumn("bin", idx)
    return (placed.groupBy("bin", "_lo", "_width", "median").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", "n", (F.col("_lo") + (F.col("bin") - 1) * F.col("_width")).alias("bin_lo"),
                    (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_hi"), "median"))
