"""Spark ML models: word importance (M6-M9) and sequence forecasts.

Training sets are one row per month / period window, i.e. bounded by the
calendar; they are built by distributed jobs from the full tables.  Scaling
follows scikit-learn's conventions (population std, constant min-max -> 0),
implemented as literal-array expressions (see ``scaling``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import (GBTRegressor, LinearRegression, RandomForestRegressor)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import EXTRA_PREFIXES, MIN_DATA_MONTHS, SEQUENCE_FEATURES, VALIDATION_SHARE, ForecastParams
from ..session import materialise
from . import aggregate as agg
from . import metrics as met
from . import sequences as sq
from . import timeseries as ts
from .dual import WordDesign, lasso_coefficients, optimality, ridge_coefficients
from .words import correlation_scores, normalise_importance, training_set, vocabulary, with_scalars

RIDGE_ALPHA = 1.0
LASSO_ALPHA = 0.1
TREES = 100
SEED = 42
WORD_METHODS = ("ridge", "lasso", "random_forest", "gradient_boosting")
HUBER_L2 = 0.1
HUBER_DELTA = 1.0                 # the reference's loss: squared up to an error of 1 on the scaled target, linear beyond
HUBER_ROUNDS, HUBER_TOLERANCE = 100, 1e-9


# --- helpers ---------------------------------------------------------------------
ROWS_PER_TRAIN_PARTITION = 50_000


def sized_for_fit(df: DataFrame, n_rows: int) -> DataFrame:
    """Training sets here have one row per month / window; iterative solvers
    launch a job per iteration, so they get partitions sized by rows
    (ceil(n / 50k)), not the shuffle-partition count of the job that built them."""
    return df.coalesce(max(1, -(-n_rows // ROWS_PER_TRAIN_PARTITION)))


def _lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _scale_array(arr: Column, means, stds) -> Column:
    """(x - mean) / std element-wise with literal arrays (std 0 -> 1)."""
    m = _lit_array(means)
    s = _lit_array([v if v else 1.0 for v in stds])
    return F.zip_with(F.zip_with(arr, m, lambda x, a: x - a), s, lambda d, b: d / b)


# --- word importance -----------------------------------------------------------------
def word_design(words: DataFrame, sales: DataFrame):
    """J3 + M1 + sklearn StandardScaler, for the tree models: (month, y, features), the indexed vocabulary
    (word, idx), the numbers of months and words.

    Features are sparse: presence over the word's population standard deviation (constant
    words: 1), one row per training month.  Centring is left out (trees don't see a shift).
    The vocabulary stays a distributed table; its size alone reaches the driver.
    """
    words = materialise(words.select("month", "word").distinct(), "month-words")
    train = materialise(training_set(words, sales).select("month", F.col("sales").cast("double").alias("y")), "train-months")
    vocab = materialise(vocabulary(words), "vocabulary")          # of ALL months, also months without a sale
    n_months, n_words = train.count(), vocab.count()
    share = F.col("n") / F.lit(float(max(n_months, 1)))
    held = words.join(train.select("month"), "month")
    unit = held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", F.sqrt(share * (1 - share)).alias("std"))
    cells = (held.join(unit, "word").where("std > 0").join(vocab, "word")
             .groupBy("month").agg(F.sort_array(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), (1 / F.col("std")).alias("x")))).alias("cells")))
    vector = F.udf(lambda cells: Vectors.sparse(n_words, [c["idx"] for c in cells or ()], [c["x"] for c in cells or ()]), VectorUDT())   # a row per month
    x = train.join(cells, "month", "left").select("month", "y", vector("cells").alias("features"))
    return sized_for_fit(x, n_months), vocab, n_months, n_words


def fit_word_trees(x: DataFrame, method: str):
    """One of the reference's two tree estimators on the design; (index, importance) of the words it uses."""
    if method == "random_forest":
        est = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=TREES, seed=SEED,
                                    featureSubsetStrategy="all", maxDepth=20, minInstancesPerNode=1,
                                    bootstrap=True)
    elif method == "gradient_boosting":
        est = GBTRegressor(featuresCol="features", labelCol="y", maxIter=TREES, maxDepth=3,
                           stepSize=0.1, seed=SEED)
    else:
        raise ValueError(f"unsupported method {method!r}")
    used = est.fit(x).featureImportances
    return x.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(used.indices, used.values)], "idx long, raw_importance double")


def _coefficients(words: DataFrame, sales: DataFrame, method: str) -> tuple[DataFrame, WordDesign | None]:
    """(word, raw_importance) of every word, and the design of the linear methods."""
    if method not in WORD_METHODS:
        raise ValueError(f"unsupported method {method!r}")
    if method in ("ridge", "lasso"):
        design = WordDesign(words, training_set(words, sales))
        fit = ridge_coefficients if method == "ridge" else lasso_coefficients
        return materialise(fit(design, RIDGE_ALPHA if method == "ridge" else LASSO_ALPHA), "word-coefficients"), design
    x, vocab, n, _ = word_design(words, sales)
    if n == 0:
        raise ValueError("no month has both words and sales")
    used = fit_word_trees(x, method)                               # words in some split: bounded by the trees
    return vocab.join(F.broadcast(used), "idx", "left").select("word", F.coalesce("raw_importance", F.lit(0.0)).alias("raw_importance")), None


def word_importance(words: DataFrame, sales: DataFrame, method: str = "gradient_boosting", direction_source: str = "importance") -> DataFrame:
    """M6-M9 + A12 + F5: (word, score, raw_importance, direction).

    ``direction_source``: ``importance`` takes the sign of the importance, which trees never make negative; ``corr``
    takes that of the word's correlation with sales (M10), whatever the method."""
    if direction_source not in ("importance", "corr"):
        raise ValueError(f"unknown direction source {direction_source!r}")
    found = normalise_importance(_coefficients(words, sales, method)[0])
    if direction_source == "importance":
        return found
    return found.drop("direction").join(correlation_scores(words, sales).select("word", "direction"), "word")


def importance_checks(words: DataFrame, sales: DataFrame, method: str) -> DataFrame:
    """(word, violation, valid): how far the fitted model is from what defines it.

    Ridge and lasso: each word's optimality condition, relative to the sum of
    absolute terms in it (0 at the optimum).  Trees: by how much the importances
    miss a sum of 1.  ``valid``: score within 0..1 and direction by the sign."""
    coefficients, design = _coefficients(words, sales, method)
    if design is not None:
        checked = optimality(design, coefficients, method, RIDGE_ALPHA if method == "ridge" else LASSO_ALPHA)
    else:
        total = coefficients.agg(F.abs(F.sum("raw_importance") - 1.0).alias("violation"))
        checked = with_scalars(coefficients, total)
    trees = F.lit(design is None)
    named = normalise_importance(coefficients).select(
        "word", ((F.col("score") >= 0) & (F.col("score") <= 1) & (F.col("direction") == F.when(F.col("raw_importance") > 0, "positive").otherwise("negative"))
                 & (~trees | (F.col("raw_importance") >= 0))).alias("valid"))
    return checked.select("word", F.round("violation", 4).alias("violation")).join(named, "word")


# --- sequence forecast (pipeline A) ------------------------------------------------
def _extras(cols: list[str]) -> list[str]:
    return [c for c in cols if c.startswith(EXTRA_PREFIXES)]


def _sum_of(f: int, square: bool):
    if square:
        return lambda acc, row: acc + row[f] * row[f]
    return lambda acc, row: acc + row[f]


def _train_stats(train: DataFrame, n_feat: int, n_extra: int):
    """Pooled sequence statistics, extras statistics and the target range in
    ONE aggregation over the training windows (instead of one job each).

    Pooled mean / population std use the per-window sums and sums of squares
    of every timestep (``aggregate`` over the window array): no explode.
    """
    aggs = [F.sum(F.size("x_seq")).alias("cells")]
    for f in range(n_feat):
        aggs += [F.sum(F.aggregate("x_seq", F.lit(0.0), _sum_of(f, False))).alias(f"s{f}"),
                 F.sum(F.aggregate("x_seq", F.lit(0.0), _sum_of(f, True))).alias(f"q{f}")]
    for i in range(n_extra):
        aggs += [F.avg(F.col("x_extra")[i]).alias(f"em{i}"), F.stddev_pop(F.col("x_extra")[i]).alias(f"es{i}")]
    aggs += [F.min("y").alias("ylo"), F.max("y").alias("yhi")]
    r = train.agg(*aggs).first()
    cells = float(r["cells"])
    means = [r[f"s{f}"] / cells for f in range(n_feat)]
    stds = [max(r[f"q{f}"] / cells - means[f] ** 2, 0.0) ** 0.5 for f in range(n_feat)]
    extra = ([r[f"em{i}"] or 0.0 for i in range(n_extra)], [r[f"es{i}"] or 0.0 for i in range(n_extra)])
    return (means, stds), extra, float(r["ylo"]), float(r["yhi"])


def _design(seq: DataFrame, n_feat: int, seq_stats, extra_stats) -> Column:
    m, s = seq_stats
    scaled_rows = F.transform("x_seq", lambda row: _scale_array(row, m, s))
    ex_scaled = _scale_array(F.col("x_extra"), *extra_stats) if extra_stats[0] else F.col("x_extra")
    return array_to_vector(F.concat(F.flatten(scaled_rows), ex_scaled))


def forecast(full: DataFrame, p: ForecastParams, model: str = "gbt",
             saved: tuple | None = None) -> tuple[DataFrame, dict]:
    """M13 + M15 + M17: scale (fit on the training prefix), train, evaluate, predict.

    Returns (per-window predictions, prediction record).  ``model`` is
    ``gbt`` (GBTRegressor with the validation suffix as early-stopping set) or
    ``huber`` (LinearRegression with Huber loss, the reference's loss).
    A saved (model, state) pair (M19) can be passed as ``saved``; it is then
    evaluated and used for the prediction with its own columns, scalers and target range,
    whatever the data now hold: columns it doesn't know are left out, columns that are gone count as 0.
    """
    fitted, state = saved or (None, None)
    if state:
        L, extras, features = state["length"], state["extras"], state["features"]
        full = full.withColumns({c: F.lit(0.0) for c in features + extras if c not in full.columns})
    else:
        L = p.resolved_sequence_length()
        extras = _extras(full.columns)
        features = [c for c in SEQUENCE_FEATURES if c in full.columns]      # PF4: keep those present
    seq = sq.build_sequences(full, features, p.target, L, extras=extras,
                             same_period_extras=p.same_period_extras)
    if not p.same_period_extras:
        seq = seq.where(F.col("x_extra").isNotNull())
    seq = ts.chrono_split(seq, p.validation_share).withColumn("is_val", F.col("split") == "validation")
    # One row per window (calendar-bounded): keep it for the fit's several passes.
    seq = seq.persist()
    n = seq.count()
    record = {"freq": p.freq, "model": model, "n_samples": n}
    if n < max(p.min_windows, 2):
        record.update(status="insufficient_data")
        seq.unpersist()
        return None, record
    if state:
        seq_stats, extra_stats, ylo, yhi = state["seq_stats"], state["extra_stats"], state["ylo"], state["yhi"]
    else:
        seq_stats, extra_stats, ylo, yhi = _train_stats(seq if p.scale_on_all else seq.where(~F.col("is_val")), len(features), len(extras))
    yrange = (yhi - ylo) or 1.0
    design = seq.select("period", "y", "is_val", _design(seq, len(features), seq_stats, extra_stats)
                        .alias("features"), ((F.col("y") - F.lit(ylo)) / F.lit(yrange)).alias("y_scaled"))
    design = sized_for_fit(design, n)
    if fitted is not None:
        pass
    elif model == "gbt":
        est = GBTRegressor(featuresCol="features", labelCol="y_scaled", maxIter=p.max_iter, maxDepth=3,
                           stepSize=0.1, seed=p.seed, validationIndicatorCol="is_val",
                           validationTol=0.01)
        fitted = est.fit(design)
    elif model == "huber":
        fitted = fit_huber(design.where(~F.col("is_val")))
    else:
        raise ValueError(f"unknown model {model!r}")
    pred = fitted.transform(design).withColumn(
        "y_pred", F.col("prediction") * F.lit(yrange) + F.lit(ylo)).select("period", "y", "y_pred", "is_val")
    # in-sample (all windows) and holdout metrics in one aggregation
    scoped = pred.select("*", F.explode(F.array(F.lit("all"), F.when(F.col("is_val"), F.lit("holdout"))))
                         .alias("scope")).where(F.col("scope").isNotNull())
    by_scope = {r["scope"]: r for r in met.regression_metrics(scoped, group_cols=["scope"]).collect()}
    allm = by_scope["all"]
    hold = by_scope.get("holdout") or {"MAE": None, "RMSE": None}
    nxt = sq.last_training_window(seq) if p.next_from_training else sq.next_window(full, features, L, extras=extras)
    nxt_pred = fitted.transform(nxt.select(
        _design(nxt, len(features), seq_stats, extra_stats).alias("features"))).first()
    last = ts.last_observation(full, p.target).first()
    predicted = float(nxt_pred["prediction"]) * yrange + ylo if nxt_pred else None
    last_value = float(last["last_value"])
    record.update(
        status="success", **{k: float(allm[k]) for k in ("MAE", "MSE", "RMSE", "R2", "MAPE")},
        holdout_MAE=float(hold["MAE"]) if hold["MAE"] is not None else None,
        holdout_RMSE=float(hold["RMSE"]) if hold["RMSE"] is not None else None,
        last_period=str(last["last_period"]), last_value=last_value, predicted_value=predicted,
        change_percent=((predicted - last_value) / last_value * 100) if (predicted is not None and last_value)
        else 0.0,
        timestamp=_dt.datetime.now(_dt.timezone.utc).isoformat(timespec="seconds"))
    record["_model"] = fitted
    record["_state"] = {"freq": p.freq, "kind": model, "target": p.target, "length": L, "features": features,
                        "extras": extras, "seq_stats": seq_stats, "extra_stats": extra_stats, "ylo": ylo, "yhi": yhi}
    seq.unpersist()
    return pred, record


def training_windows(full: DataFrame, state: dict, p: ForecastParams) -> DataFrame:
    """(period, y_scaled, features): the windows a model of this state was fitted on, scaled as for its fit."""
    seq = sq.build_sequences(full, state["features"], state["target"], state["length"], extras=state["extras"], same_period_extras=p.same_period_extras)
    if not p.same_period_extras:
        seq = seq.where(F.col("x_extra").isNotNull())
    train = ts.chrono_split(seq, p.validation_share).where("split = 'train'")
    return train.select("period", ((F.col("y") - F.lit(state["ylo"])) / F.lit((state["yhi"] - state["ylo"]) or 1.0)).alias("y_scaled"),
                        _design(seq, len(state["features"]), state["seq_stats"], state["extra_stats"]).alias("features"))


def fit_huber(train: DataFrame, penalty: float = HUBER_L2, delta: float = HUBER_DELTA, rounds: int = HUBER_ROUNDS):
    """The linear model that minimises mean(H(y_scaled - Xw - b)) + penalty / 2 x |w|^2, H the Huber loss of a fixed ``delta``.

    Reweighted least squares: rows beyond ``delta`` weigh delta / |residual|, and each round is one exact solve of the
    normal equations, until no weight moves, at most ``rounds`` times; no round raises the loss.  Far outliers among fewer rows
    than coefficients need many rounds: ``huber_optimality`` tells what is left.  (A loss whose scale is fitted too has no minimum here: there
    are more coefficients than windows, so the scale shrinks to 0.)  Spark's penalty is relative to the
    label's spread and to the sum of weights; both are taken out again, so that it means the same in every round.
    """
    rows, model = train.select("features", "y_scaled").withColumn("weight", F.lit(1.0)), None
    n = None
    for _ in range(rounds):
        w, y = F.col("weight"), F.col("y_scaled")
        total, count, mean = rows.agg(F.sum(w), F.count(w), F.sum(w * y) / F.sum(w)).first()
        spread = rows.agg(F.sqrt(F.sum(w * F.pow(y - F.lit(mean), 2)) / F.sum(w))).first()[0]
        n = n or count
        model = LinearRegression(featuresCol="features", labelCol="y_scaled", weightCol="weight", regParam=penalty * n / total * spread,
                                 elasticNetParam=0.0, standardization=False).fit(rows)
        residual = F.abs(F.col("y_scaled") - F.col("prediction"))
        scored = model.transform(rows).withColumn("new", F.when(residual > delta, F.lit(delta) / residual).otherwise(F.lit(1.0)))
        moved = scored.agg(F.max(F.abs(F.col("new") - w))).first()[0]
        if moved <= HUBER_TOLERANCE:
            break
        rows = (model.transform(train.select("features", "y_scaled"))
                .select("features", "y_scaled", F.when(residual > delta, F.lit(delta) / residual).otherwise(F.lit(1.0)).alias("weight")))
    return model


def huber_optimality(train: DataFrame, model, penalty: float = HUBER_L2, delta: float = HUBER_DELTA) -> DataFrame:
    """(step, violation): how far a fit is from the conditions of ``fit_huber``'s minimum, relative to the size of their terms (0 there).

    Coefficient j (``step`` is its place): mean(psi x X_j) + penalty x w_j = 0, psi the residual cut at +-delta.  Intercept (step -1): mean(psi) = 0.
    """
    error = F.col("prediction") - F.col("y_scaled")
    psi = F.greatest(F.least(error, F.lit(delta)), F.lit(-delta))
    rows = model.transform(train).select(psi.alias("psi"), F.concat(F.array(F.lit(1.0)), vector_to_array("features")).alias("x"))
    cells = rows.select("psi", F.posexplode("x").alias("place", "x"))                   # training windows x coefficients
    weights = train.sparkSession.createDataFrame([(0, 0.0)] + [(i + 1, float(w)) for i, w in enumerate(model.coefficients)], "place int, w double")
    sums = cells.groupBy("place").agg(F.avg(F.col("psi") * F.col("x")).alias("g"), F.avg(F.abs(F.col("psi") * F.col("x"))).alias("size"))
    pull = F.lit(penalty) * F.col("w")
    return sums.join(F.broadcast(weights), "place").select(
        (F.col("place") - 1).alias("step"), F.coalesce(F.try_divide(F.abs(F.col("g") + pull), F.col("size") + F.abs(pull)), F.lit(0.0)).alias("violation"))


def _number(row, name):
    return float(row[name]) if row is not None and row[name] is not None else None


RECORD_SCHEMA = ("freq string, model string, status string, n_samples long, MAE double, MSE double, "
                 "RMSE double, R2 double, MAPE double, holdout_MAE double, holdout_RMSE double, "
                 "last_period string, last_value double, predicted_value double, change_percent double, error string")


def record_frame(spark, records: list[dict]) -> DataFrame:
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    rows = [tuple(r.get(n) for n in names) for r in records]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def forecast_from_facts(facts: DataFrame, p: ForecastParams, model: str = "gbt"):
    full = agg.full_dataset(facts, p.freq)
    return forecast(agg.drop_partial_last(full, facts, p.freq) if p.drop_partial_last else full, p, model)


# --- word-score forecast (pipeline C) -----------------------------------------------
def word_forecast(matrix: DataFrame, next_vec: DataFrame, length: int = 12, min_months: int = MIN_DATA_MONTHS,
                  validation_share: float = VALIDATION_SHARE, saved: tuple | None = None, word_offset: int = 1) -> dict:
    """M14 + M16: sequences of (word scores ++ sales) over ``length`` months plus
    the last timestep's word vector -> next month's sales; predicted with the
    last ``length`` months and next month's word vector (J7).  Scalers and
    model are fitted on the windows before the chronological validation suffix;
    a ``saved`` (model, state) pair is applied with its own words and scalers.

    ``word_offset``: the word vector learned from is that of so many months before the target; 1 as in the
    reference, 0 for the target month's own, which is what the prediction is given."""
    if word_offset not in (0, 1):
        raise ValueError("word_offset is 0 or 1")
    fitted, state = saved or (None, None)
    if state:
        word_cols, length, word_offset = state["word_cols"], state["length"], state.get("word_offset", 1)
        matrix = matrix.withColumns({c: F.lit(0.0) for c in word_cols if c not in matrix.columns})
    else:
        word_cols = sorted(c for c in matrix.columns if c.startswith("word_score_"))
    feats = word_cols + ["sales"]
    m = matrix.withColumn("period", F.date_format("month", "yyyy-MM")).persist()  # one row per month
    n_months = m.count()
    rec = {"freq": "monthly", "model": "words_linear", "n_samples": 0}
    if n_months < min_months or n_months <= length:
        rec.update(status="insufficient_data")
        m.unpersist()
        return rec
    own = word_cols if word_offset == 0 else None
    seq = sq.build_sequences(m, feats, "sales", length, extras=own)
    if not own:
        seq = seq.withColumn("x_extra", F.slice("x_last", 1, len(word_cols)))
    seq = ts.chrono_split(seq, validation_share).withColumn("is_val", F.col("split") == "validation").persist()
    rec["n_samples"] = seq.count()
    if state:
        seq_stats, extra_stats, ylo, yhi = state["seq_stats"], state["extra_stats"], state["ylo"], state["yhi"]
    else:
        seq_stats, extra_stats, ylo, yhi = _train_stats(seq.where(~F.col("is_val")), len(feats), len(word_cols))
    yr = (yhi - ylo) or 1.0
    design = seq.select("period", "y", "is_val", _design(seq, len(feats), seq_stats, extra_stats).alias("features"),
                        ((F.col("y") - F.lit(ylo)) / F.lit(yr)).alias("y_scaled"))
    design = sized_for_fit(design, rec["n_samples"])
    if fitted is None:
        fitted = LinearRegression(featuresCol="features", labelCol="y_scaled", regParam=1e-2,
                                  elasticNetParam=0.0).fit(design.where(~F.col("is_val")))
    pred = fitted.transform(design).withColumn("y_pred", F.col("prediction") * F.lit(yr) + F.lit(ylo))
    allm = met.regression_metrics(pred).first()
    hold = met.regression_metrics(pred.where("is_val")).first()
    vec_rows = next_vec.collect()                      # one row per vocabulary word
    vec = {r["word"]: float(r["score"]) for r in vec_rows}
    if vec_rows and "source_month" in vec_rows[0]:
        rec["source_month"] = vec_rows[0]["source_month"]
    nxt = sq.next_window(m, feats, length).withColumn(
        "x_extra", _lit_array([vec.get(c[len("word_score_"):], 0.0) for c in word_cols]))
    out = fitted.transform(nxt.select(_design(nxt, len(feats), seq_stats, extra_stats).alias("features"))).first()
    last = ts.last_observation(m, "sales").first()
    predicted = float(out["prediction"]) * yr + ylo
    rec.update(status="success", **{k: float(allm[k]) for k in ("MAE", "MSE", "RMSE", "R2", "MAPE")},
               holdout_MAE=_number(hold, "MAE"), holdout_RMSE=_number(hold, "RMSE"),
               n_word_columns=len(word_cols), sequence_length=length,
               timestamp=_dt.datetime.now(_dt.timezone.utc).isoformat(timespec="seconds"),
               last_period=str(last["last_period"]), last_value=float(last["last_value"]),
               predicted_value=predicted,
               change_percent=((predicted - float(last["last_value"])) / float(last["last_value"]) * 100)
               if last["last_value"] else 0.0)
    rec["_model"] = fitted
    rec["_state"] = {"kind": "words_linear", "word_cols": word_cols, "length": length, "seq_stats": seq_stats,
                     "extra_stats": extra_stats, "ylo": ylo, "yhi": yhi, "word_offset": word_offset}
    seq.unpersist()
    m.unpersist()
    return rec
