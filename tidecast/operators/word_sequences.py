"""Forecast from word-score sequences of any vocabulary (W8, M14, M16): ridge in its dual, words kept sparse.

A window of ``length`` months has length x (words + 1) features (each month's scores and its sales) and the
last month's scores once more (with ``word_offset`` 0 the target month's; for the forecast: the next month's, J7).  There are far more features than windows, and
far more words than a frame has columns, so no window is ever built:

* a word is one row, (word, cells): its scores other than 0 by month number.  Scaling statistics pool a month as
  often as training windows hold it;
* the product of two windows is a sum over steps of products of two months, so a months x months Gram
  matrix (aggregated from pairs of a word's months, map-side) gives every product of windows;
* the dual variables solve one system of the size of the training windows, and each word's
  coefficients, one per step, come from one pass over its cells.

The penalty is chosen on the chronological validation suffix: the path runs from the firmest one and stops
where the suffix's error has not fallen for ``PATIENCE`` steps, as early stopping does for an iterative fit.

The driver holds arrays of months (``dual.MAX_MONTHS``, checked); everything as long as the vocabulary stays a table.
Defined results: sales without a month are left out; of several scores of a word in a month the largest
counts; NULL words and scores are left out; a word that never changes has coefficients of 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import MIN_DATA_MONTHS, VALIDATION_SHARE
from ..session import materialise
from .dual import MAX_MONTHS
from .words import sales_month_key

PENALTIES = (10.0, 3.0, 1.0, 0.3, 0.1, 0.03, 0.01)
PATIENCE = 2
ROUNDING = 1e-20                  # a variance below this share of the second moment is rounding


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(cells: str, term) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda s, c: s + term(c))


class SequenceDesign:
    """Words by month number, their scaling, and the products of windows.

    Months are numbered 0 .. n-1; number n is the month to forecast, of which only the scores are known.
    Window o (of ``windows``) has months o .. o+length-1 and month o+length as its target."""

    def __init__(self, scores: DataFrame, sales: DataFrame, upcoming: DataFrame, length: int, validation_share: float = VALIDATION_SHARE,
                 word_offset: int = 1):
        rows = (sales_month_key(sales).where("month_str is not null").select("month_str", F.col("sales").cast("double").alias("sales"))
                .orderBy("month_str", "sales").limit(MAX_MONTHS + 1).collect())
        if len(rows) > MAX_MONTHS:
            raise ValueError(f"more than {MAX_MONTHS} months")
        if word_offset not in (0, 1):
            raise ValueError("word_offset is 0 or 1")
        self.spark, self.length, self.n = scores.sparkSession, length, len(rows)
        self.end = length - word_offset                 # the month of a window whose scores stand once more
        self.periods, self.sales = [r["month_str"] for r in rows], np.array([r["sales"] for r in rows], dtype=float)
        self.windows = max(self.n - length, 0)
        self.train = int(np.floor(self.windows * (1.0 - validation_share)))
        if self.train == 0:
            return
        pooled, last = np.zeros(self.n + 1), np.zeros(self.n + 1)
        for o in range(self.train):
            pooled[o:o + length] += 1
            last[o + self.end] += 1
        self.pooled = pooled[:self.n]
        numbered = self.spark.createDataFrame([(r["month_str"], i) for i, r in enumerate(rows)], "month string, m int")
        held = scores.select("month", "word", F.col("score").cast("double").alias("x")).where("word is not null")
        held = held.join(F.broadcast(numbered), "month", "left").select("word", "m", "x")         # at most MAX_MONTHS rows
        held = held.unionByName(upcoming.where("word is not null").select("word", F.lit(self.n).alias("m"), F.col("score").cast("double").alias("x")))
        held = held.groupBy("word", "m").agg(F.max("x").alias("x"))
        cell = F.when(F.col("m").isNotNull() & (F.col("x") != 0), F.struct("m", "x"))
        words = held.groupBy("word").agg(F.array_sort(F.collect_list(cell)).alias("cells"))       # at most MAX_MONTHS cells a word
        for name, weights in (("1", pooled), ("2", last)):
            by_month, total = _numbers(weights), F.lit(float(weights.sum()))
            words = words.withColumn(f"mean{name}", _sum("cells", lambda c: F.get(by_month, c["m"]) * c["x"]) / total)
            off = _sum("cells", lambda c: F.get(by_month, c["m"]) * F.pow(c["x"] - F.col(f"mean{name}"), 2))
            absent = total - _sum("cells", lambda c: F.get(by_month, c["m"]))
            square = _sum("cells", lambda c: F.get(by_month, c["m"]) * c["x"] * c["x"]) / total
            words = words.withColumn(f"var{name}", (off + absent * F.pow(f"mean{name}", 2)) / total)
            words = words.withColumn(f"inv{name}", F.when(F.col(f"var{name}") > square * ROUNDING, 1 / F.sqrt(f"var{name}")).otherwise(F.lit(0.0)))
        self.words = materialise(words.drop("var1", "var2"), "word-cells")
        mean = (self.pooled * self.sales).sum() / self.pooled.sum()
        std = np.sqrt((self.pooled * (self.sales - mean) ** 2).sum() / self.pooled.sum())
        self.sales_z = (self.sales - mean) / (std or 1.0)
        lo, hi = (f(self.sales[length:length + self.train]) for f in (np.min, np.max))
        self.lo, self.range = lo, (hi - lo) or 1.0
        self.y = (self.sales[length:] - self.lo) / self.range

    def products(self) -> np.ndarray:
        """Inner products of all windows' features; the last row and column are the window of the forecast."""
        size, w = self.n + 1, self.words
        first = w.select("cells", F.pow("inv1", 2).alias("v1"), F.pow("inv2", 2).alias("v2"), F.posexplode("cells").alias("at", "a"))
        pairs = first.select("a", "v1", "v2", F.explode(F.expr("slice(cells, at + 1, size(cells))")).alias("b"))
        shared = (pairs.groupBy(F.col("a.m").alias("a"), F.col("b.m").alias("b"))
                  .agg(*[F.sum(F.col("a.x") * F.col("b.x") * F.col(v)).alias(v) for v in ("v1", "v2")]).collect())       # months^2 / 2 at most
        pull = [(F.col(f"mean{i}") * F.pow(f"inv{i}", 2)) for i in (1, 2)]
        single = (w.select(F.explode("cells").alias("c"), *[p.alias(f"u{i}") for i, p in enumerate(pull, 1)])
                  .groupBy(F.col("c.m").alias("m")).agg(*[F.sum(F.col("c.x") * F.col(u)).alias(u) for u in ("u1", "u2")]).collect())
        constant = w.agg(*[F.sum(p * F.col(f"mean{i}")).alias(f"c{i}") for i, p in enumerate(pull, 1)]).first()
        gram = {}
        for i in "12":
            k, u = np.zeros((size, size)), np.zeros(size)
            for r in shared:
                k[r["a"], r["b"]] = k[r["b"], r["a"]] = r[f"v{i}"]
            for r in single:
                u[r["m"]] = r[f"u{i}"]
            gram[i] = k - u[:, None] - u[None, :] + (constant[f"c{i}"] or 0.0)
        months = gram["1"][:self.n, :self.n] + np.outer(self.sales_z, self.sales_z)
        starts = np.arange(self.windows + 1)
        out = sum(months[np.ix_(starts + t, starts + t)] for t in range(self.length))
        ends = np.append(np.arange(self.windows) + self.end, self.n)
        return out + gram["2"][np.ix_(ends, ends)]

    def solve(self, k: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """(dual variables, predictions of every window and of the forecast): minimises
        |y - Zw - b|^2 / (2 T) + penalty |w|^2 / 2 over the T training windows."""
        t = self.train
        inner = k[:t, :t]
        centred = inner - inner.mean(0) - inner.mean(1)[:, None] + inner.mean()
        y = self.y[:t]
        dual = np.linalg.solve(centred + t * penalty * np.eye(t), y - y.mean())
        return dual, y.mean() + (k[:, :t] - inner.mean(0)) @ dual          # the dual sums to 0, so row means don't matter

    def fit(self, penalties=PENALTIES, patience: int = PATIENCE) -> dict:
        """Walk the path of penalties, firmest first; keep the one with the least error on the suffix."""
        k, best, waited = self.products(), None, 0
        for penalty in penalties:
            dual, fitted = self.solve(k, penalty)
            held_out = np.arange(self.train, self.windows)
            scored = held_out if len(held_out) else np.arange(self.train)
            error = float(np.mean((fitted[scored] - self.y[scored]) ** 2))
            if best is None or error < best["error"]:
                best, waited = {"penalty": penalty, "dual": dual, "fitted": fitted, "error": error}, 0
            else:
                waited += 1
                if waited >= patience:
                    break
        return best

    def _at_steps(self, values: np.ndarray, inv: str) -> Column:
        """Per step t: sum over a word's cells of score x value of the window whose step t is that month, scaled."""
        by_window = _numbers(values)
        return F.transform(F.sequence(F.lit(0), F.lit(self.length - 1)),
                           lambda t: _sum("cells", lambda c: F.coalesce(F.get(by_window, c["m"] - t), F.lit(0.0)) * c["x"]) * F.col(inv))

    def _at_end(self, values: np.ndarray, inv: str) -> Column:
        by_window = _numbers(values)
        return _sum("cells", lambda c: F.coalesce(F.get(by_window, c["m"] - self.end), F.lit(0.0)) * c["x"]) * F.col(inv)

    def coefficients(self, dual: np.ndarray) -> DataFrame:
        """One row per word: ``steps`` (coefficient of the word's scaled score at each step, oldest first) and ``extra``."""
        return self.words.select("*", self._at_steps(dual, "inv1").alias("steps"), self._at_end(dual, "inv2").alias("extra"))

    def sales_coefficients(self, dual: np.ndarray) -> np.ndarray:
        return np.array([(dual * self.sales_z[t:t + self.train]).sum() for t in range(self.length)])

    def primal_predictions(self, coefficients: DataFrame, dual: np.ndarray) -> np.ndarray:
        """Every window's (and the forecast's) prediction from the coefficients instead of the dual."""
        def part(window, value):
            return F.struct(window.cast("int").alias("o"), value.alias("v"))

        in_steps = F.transform(F.filter("cells", lambda c: c["m"] < self.n), lambda c: F.transform(
            "steps", lambda w, t: part(c["m"] - t, w * c["x"] * F.col("inv1"))))
        # the forecast's extra scores are month n's; with an offset, those of month n-1 stand in no window once more
        held = F.filter("cells", lambda c: (c["m"] == self.n) | (c["m"] < self.windows + self.end))
        at_end = F.transform(held, lambda c: part(
            F.when(c["m"] == self.n, F.lit(self.windows)).otherwise(c["m"] - self.end), F.col("extra") * c["x"] * F.col("inv2")))
        both = coefficients.select(F.explode(F.concat(F.flatten(in_steps), at_end)).alias("p")).where(F.col("p.o").between(0, self.windows))
        sums = both.groupBy(F.col("p.o").alias("o")).agg(F.sum("p.v").alias("v")).collect()           # a row per window
        offset = coefficients.agg(F.sum(F.aggregate("steps", F.lit(0.0), lambda s, w: s + w) * F.col("mean1") * F.col("inv1")
                                        + F.col("extra") * F.col("mean2") * F.col("inv2"))).first()[0] or 0.0
        raw = np.full(self.windows + 1, -offset)
        for r in sums:
            raw[r["o"]] += r["v"]
        weights = self.sales_coefficients(dual)
        raw += np.array([weights @ self.sales_z[o:o + self.length] for o in range(self.windows + 1)])
        return raw - raw[:self.train].mean() + self.y[:self.train].mean()

    def violations(self, coefficients: DataFrame, predicted: np.ndarray, penalty: float) -> DataFrame:
        """(word, violation): the largest miss of the normal equations among the word's coefficients, with
        residuals of ``predicted``, relative to the sizes of the terms (0 at the minimum)."""
        error = (predicted[:self.train] - self.y[:self.train]) / self.train
        size = np.abs(error)
        gradient = F.zip_with(self._at_steps(error, "inv1"), "steps", lambda g, w: F.abs(g + F.lit(penalty) * w))
        terms = F.zip_with(self._at_steps(size, "inv1"), "steps", lambda g, w: F.abs(g) + F.lit(penalty) * F.abs(w))
        end = F.abs(self._at_end(error, "inv2") + F.lit(penalty) * F.col("extra"))
        end_size = F.abs(self._at_end(size, "inv2")) + F.lit(penalty) * F.abs("extra")
        largest = F.greatest(F.array_max(terms), end_size)
        return coefficients.select("word", F.when(largest > 0, F.greatest(F.array_max(gradient), end) / largest).otherwise(F.lit(0.0)).alias("violation"))


def sparse_word_forecast(scores: DataFrame, sales: DataFrame, upcoming: DataFrame, length: int = 12, min_months: int = MIN_DATA_MONTHS,
                         validation_share: float = VALIDATION_SHARE, word_offset: int = 1) -> tuple[dict, DataFrame | None]:
    """(record, words' coefficients with violations) of the ridge forecast.

    ``scores``: (month, word, score); ``sales``: (month, sales); ``upcoming``: the next month's (word, score), J7.
    ``word_offset``: months from the extra scores learned from to the target (1 as in the reference, or 0)."""
    design = SequenceDesign(scores, sales, upcoming, length, validation_share, word_offset)
    record = {"freq": "monthly", "model": "words_ridge_sparse", "n_samples": design.windows}
    if design.n < min_months or design.train == 0:
        return {**record, "status": "insufficient_data"}, None
    fit = design.fit()
    coefficients = materialise(design.coefficients(fit["dual"]), "word-step-coefficients")
    primal = design.primal_predictions(coefficients, fit["dual"])
    checked = design.violations(coefficients, primal, fit["penalty"])
    values = primal * design.range + design.lo
    y, last = design.sales[length:], float(design.sales[-1])
    e = y - values[:-1]
    spread = float(((y - y.mean()) ** 2).sum())
    nonzero = y != 0
    record.update(status="success", MAE=float(np.abs(e).mean()), MSE=float((e ** 2).mean()), RMSE=float(np.sqrt((e ** 2).mean())),
                  R2=1 - float((e ** 2).sum()) / spread if spread else float(not e.any()),
                  MAPE=float(np.abs(e[nonzero] / y[nonzero]).mean() * 100) if nonzero.any() else 0.0,
                  last_period=design.periods[-1], last_value=last, predicted_value=float(values[-1]),
                  change_percent=(float(values[-1]) - last) / last * 100 if last else 0.0, penalty=fit["penalty"],
                  dual_miss=float(np.abs(primal - fit["fitted"]).max()))
    return record, coefficients.select("word", "steps", "extra").join(checked, "word")
