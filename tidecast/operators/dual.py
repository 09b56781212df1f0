"""Ridge and lasso over presence columns when there are far more words than months.

Rows are (month, word); a word's column is 1 in its months, standardised with its mean and population
standard deviation (a constant column is 0).  Months are bounded by the calendar, words are not: whatever is
as long as the vocabulary stays a distributed table, and the driver holds only arrays of months.

* Words are kept as (word, months): the sorted numbers of the months that have it.
* Ridge is solved in its dual: the months x months Gram matrix comes from pairs of months that share a
  word (at most months^2 pairs a word, aggregated map-side), the dual variables from one linear system of that
  size, and each word's coefficient from one pass over its months.
* Lasso is solved on a working set: one pass finds the words whose gradient breaks the optimality
  condition the most, the problem over the set (a few times the months) is solved exactly by sign search, and words
  with a zero coefficient leave again.  It ends when no word of the whole vocabulary breaks the condition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

MAX_MONTHS = 2_000            # months^2 numbers on the driver: 32 MB
NEW_WORDS = 64                # words that join the working set at a time
TOLERANCE = 1e-9


class WordDesign:
    """Standardised presence of words over the training months."""

    def __init__(self, words: DataFrame, train: DataFrame):
        """``words``: (month, word); ``train``: (month, sales), one row per training month."""
        rows = train.select("month", F.col("sales").cast("double").alias("sales")).orderBy("month").limit(MAX_MONTHS + 1).collect()
        if not rows:
            raise ValueError("no month has both words and sales")
        if len(rows) > MAX_MONTHS:
            raise ValueError(f"more than {MAX_MONTHS} months")
        self.spark = words.sparkSession
        self.n = len(rows)
        self.y = np.array([r["sales"] for r in rows])
        numbers = self.spark.createDataFrame([(r["month"], i) for i, r in enumerate(rows)], "month string, m int")
        held = (words.select("month", "word").distinct().join(F.broadcast(numbers), "month", "left")
                .groupBy("word").agg(F.array_sort(F.collect_set("m")).alias("months")))       # at most MAX_MONTHS of a word
        share = F.size("months") / F.lit(float(self.n))
        self.words = materialise(held.withColumn("mean", share).withColumn("std", F.sqrt(share * (1 - share))), "word-months")

    def varying(self) -> DataFrame:
        return self.words.where("std > 0")

    def _by_month(self, values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    def products(self, values: np.ndarray) -> Column:
        """Inner product of a word's standardised column with ``values`` (one per month)."""
        here = F.aggregate("months", F.lit(0.0), lambda s, m: s + F.get(self._by_month(values), m))
        return F.when(F.col("std") > 0, (here - F.col("mean") * F.lit(float(values.sum()))) / F.col("std")).otherwise(F.lit(0.0))

    def gram(self) -> np.ndarray:
        """Months x months inner products of the standardised rows, from the months that share a word."""
        weighted = self.varying().select("months", (1 / (F.col("std") * F.col("std"))).alias("v"), "mean")
        first = weighted.select("months", "v", F.posexplode("months").alias("at", "a"))
        pairs = first.select("a", "v", F.explode(F.expr("slice(months, at + 1, size(months))")).alias("b"))
        shared = pairs.groupBy("a", "b").agg(F.sum("v").alias("s")).collect()                 # months^2 / 2 at most
        single = weighted.select(F.explode("months").alias("a"), (F.col("v") * F.col("mean")).alias("u")).groupBy("a").agg(F.sum("u").alias("u")).collect()
        constant = weighted.agg(F.sum(F.col("v") * F.col("mean") * F.col("mean"))).first()[0] or 0.0
        k, u = np.zeros((self.n, self.n)), np.zeros(self.n)
        for r in shared:
            k[r["a"], r["b"]] = k[r["b"], r["a"]] = r["s"]
        for r in single:
            u[r["a"]] = r["u"]
        return k - u[:, None] - u[None, :] + constant

    def column(self, months: list[int]) -> np.ndarray:
        x = np.zeros(self.n)
        x[months] = 1
        return (x - x.mean()) / x.std()


def ridge_coefficients(design: WordDesign, alpha: float) -> DataFrame:
    """(word, raw_importance) that minimise |y - Xw|^2 + alpha |w|^2 (the intercept is free)."""
    y = design.y - design.y.mean()
    dual = np.linalg.solve(design.gram() + alpha * np.eye(design.n), y)
    return design.words.select("word", design.products(dual).alias("raw_importance"))


def _sign_search(columns: np.ndarray, y: np.ndarray, pull: float, w: np.ndarray) -> np.ndarray:
    """Exact minimiser of |y - Xw|^2 / 2 + pull |w|_1: guess signs, solve for them, step to the best
    point on the way where a sign changes; the objective falls with every step.

    The columns in use stay independent: one that depends on them comes in by moving along the
    dependence, which leaves the fit as it is and shortens w, until another column is used up."""
    def objective(v):
        r = y - columns @ v
        return 0.5 * r @ r + pull * np.abs(v).sum()

    slack = TOLERANCE * np.abs(columns).T @ np.abs(y)              # what rounding leaves of the size of the terms
    w, signs = w.copy(), np.sign(w)
    barred = np.zeros(len(w), dtype=bool)                          # entering these changed nothing, by rounding
    for _ in range(100 * (columns.shape[1] + 10)):
        gradient = columns.T @ (y - columns @ w)
        active = w != 0
        if not (np.abs(gradient - pull * signs)[active] > slack[active]).any():
            over = np.where(active | barred, 0, np.abs(gradient) - pull - slack)
            if over.max(initial=0) <= 0:
                return w
            j = int(over.argmax())
            signs[j] = np.sign(gradient[j])
            if active.any():
                share = np.linalg.lstsq(columns[:, active], columns[:, j], rcond=None)[0]
                apart = columns[:, j] - columns[:, active] @ share
                if apart @ apart <= 1e-16 * (columns[:, j] @ columns[:, j]):
                    move = np.zeros(len(w))
                    move[active], move[j] = -share * signs[j], signs[j]
                    falls = active & (move * signs < 0)
                    reach = np.where(falls, np.abs(w) / np.maximum(np.abs(move), 1e-300), np.inf)
                    out = int(reach.argmin())
                    if not np.isfinite(reach[out]):
                        barred[j] = True
                        continue
                    w = w + reach[out] * move
                    w[out] = signs[out] = 0.0
            active = w != 0
            active[j] = True
        x = columns[:, active]
        target = np.zeros(len(w))
        target[active] = w[active] + np.linalg.lstsq(x.T @ x, x.T @ (y - columns @ w) - pull * signs[active], rcond=None)[0]
        step = target - w
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.where((np.sign(target) != signs) & (w != 0), -w / step, np.inf)
        best, least = None, objective(w)
        for t in [*np.unique(at[(at > 0) & (at < 1)]), 1.0]:
            v = w + t * step
            v[at == t] = 0
            if objective(v) < least:
                best, least = v, objective(v)
        if best is None:
            if not (active & (w == 0)).any():
                return w                                           # settled as far as numbers tell
            barred |= active & (w == 0)
            signs = np.sign(w)
            continue
        w, signs = best, np.sign(best)
    return w


def lasso_coefficients(design: WordDesign, alpha: float) -> DataFrame:
    """(word, raw_importance) that minimise |y - Xw|^2 / 2n + alpha |w|_1 (the intercept is free)."""
    y = design.y - design.y.mean()
    pull = alpha * design.n
    names: list[str] = []
    columns, w = np.zeros((design.n, 0)), np.zeros(0)
    size = max(float(np.abs(y).sum()), 1e-300)
    while True:
        gradient = design.products(y - columns @ w)
        gap = F.abs(gradient) - F.lit(pull)
        worst = (design.varying().where(~F.col("word").isin(names) if names else F.lit(True))
                 .select("word", "months", gap.alias("gap")).where(F.col("gap") > TOLERANCE * size)
                 .orderBy(F.desc("gap"), "word").limit(NEW_WORDS).collect())
        if not worst:
            break
        columns = np.column_stack([columns, *(design.column(r["months"]) for r in worst)])
        names += [r["word"] for r in worst]
        w = _sign_search(columns, y, pull, np.concatenate([w, np.zeros(len(worst))]))
        kept = w != 0
        if not kept[-len(worst):].any():                                       # what rounding leaves of the condition
            break
        names, columns, w = [x for x, k in zip(names, kept) if k], columns[:, kept], w[kept]
    chosen = design.spark.createDataFrame([(x, float(v)) for x, v in zip(names, w) if v], "word string, raw_importance double")
    return (design.words.select("word").join(F.broadcast(chosen), "word", "left")      # at most a few words per month
            .select("word", F.coalesce("raw_importance", F.lit(0.0)).alias("raw_importance")))


def optimality(design: WordDesign, coefficients: DataFrame, method: str, alpha: float) -> DataFrame:
    """(word, raw_importance, violation): each word's optimality condition, from the coefficients alone,
    relative to the sum of the absolute terms in it (0 at the optimum)."""
    rows = design.words.join(coefficients, "word")
    scaled = F.when(F.col("std") > 0, F.col("raw_importance") / F.col("std")).otherwise(F.lit(0.0))
    fitted = np.zeros(design.n)
    for r in rows.select(F.explode("months").alias("m"), scaled.alias("c")).groupBy("m").agg(F.sum("c").alias("s")).collect():     # one row per month
        fitted[r["m"]] = r["s"]
    fitted -= rows.agg(F.sum(F.col("mean") * scaled)).first()[0] or 0.0
    residual = design.y - design.y.mean() - fitted
    w, gradient = F.col("raw_importance"), design.products(residual)
    terms = design.products(np.abs(residual)) + 2 * F.col("mean") * F.lit(float(np.abs(residual).sum())) / F.col("std")
    if method == "ridge":
        gap = F.abs(gradient - F.lit(float(alpha)) * w)
    else:
        pull = F.lit(float(alpha * design.n))
        gap = F.when(w == 0, F.greatest(F.abs(gradient) - pull, F.lit(0.0))).otherwise(F.abs(gradient - pull * F.signum(w)))
    size = F.when(F.col("std") > 0, F.greatest(terms, F.lit(1.0))).otherwise(F.lit(1.0))
    return rows.select("word", "raw_importance", (gap / size).alias("violation"))
