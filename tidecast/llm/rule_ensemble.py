"""Quality classifier: a sparse ensemble of conjunctive rules.

Text statistics are built-in column expressions.  On a bounded sample of
labelled rows, shallow boosted trees are grown over the statistics; each path
from a root is a rule, a conjunction of one-sided conditions.  A logistic model
with an L1 penalty weighs the rules, and most weights become zero.  The rest
are compiled into one Spark column expression, so scoring a
document is a projection without Python.

Defined results: a null text counts as empty; empty texts have all statistics
zero and are scored like any other text; with no labelled rows of both classes every score is
0.5; null ids and repeated rows get a row each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, id_and_text, labelled_sample

MARKS = "#$%&*@^~=+<>_\\"
STOPS = ".,;:!?"


def with_statistics(texts: DataFrame) -> tuple[DataFrame, list[str]]:
    """``texts`` (doc_id, text, ...) with its text statistics; their names."""
    t = F.coalesce(F.col("text"), F.lit(""))
    base = texts.withColumn("text", t).withColumns({
        "n_chars": F.length("text").cast("double"),
        "words": F.array_remove(F.split(F.translate("text", "\n\t\r", "   "), " "), ""),
        "lines": F.array_remove(F.split("text", "\n"), "")})
    base = base.withColumns({
        "n_words": F.size("words").cast("double"), "n_lines": F.size("lines").cast("double"),
        "distinct_words": F.size(F.array_distinct("words")).cast("double"),
        "distinct_lines": F.size(F.array_distinct("lines")).cast("double")})

    def share(characters: str) -> Column:
        left = F.length(F.translate("text", characters, ""))
        return (F.col("n_chars") - left) / F.greatest(F.col("n_chars"), F.lit(1.0))

    ratio = {
        "mean_word": F.col("n_chars") / F.greatest(F.col("n_words"), F.lit(1.0)),
        "distinct_word_share": F.col("distinct_words") / F.greatest(F.col("n_words"), F.lit(1.0)),
        "distinct_line_share": F.col("distinct_lines") / F.greatest(F.col("n_lines"), F.lit(1.0)),
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1.0)),
        "upper_share": share(UPPER), "lower_share": share(LOWER), "digit_share": share("0123456789"),
        "stop_share": share(STOPS), "bang_share": share("!"), "bar_share": share("|"), "mark_share": share(MARKS),
    }
    names = ["n_words", "n_lines", *ratio]
    return base.withColumns(ratio).select(*texts.columns, *names), names


# --- fitting --------------------------------------------------------------

Condition = tuple[int, bool, float]          # statistic, above (else at most), threshold


@dataclass
class Rules:
    names: list[str]
    bias: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for k, above, threshold in conditions:
                c = F.col(self.names[k])
                holds = holds & ((c > threshold) if above else (c <= threshold))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(x, cuts, grad, hess, rows, path, depth, found):
    """One tree: splits of best gain; every path is a rule.  Returns leaf values by row."""
    value = np.full(len(rows), -grad[rows].sum() / (hess[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 20:
        return value
    best = (1e-6, None, None, None)
    g_all, h_all = grad[rows].sum(), hess[rows].sum()
    for k, thresholds in enumerate(cuts):
        if not len(thresholds):
            continue
        bins = np.searchsorted(thresholds, x[rows, k], side="left")      # bin i: at most thresholds[i]
        g = np.cumsum(np.bincount(bins, grad[rows], len(thresholds) + 1))[:-1]
        h = np.cumsum(np.bincount(bins, hess[rows], len(thresholds) + 1))[:-1]
        n = np.cumsum(np.bincount(bins, minlength=len(thresholds) + 1))[:-1]
        gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all ** 2 / (h_all + 1)
        gain[(n < 5) | (len(rows) - n < 5)] = 0
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], k, float(thresholds[i]), x[rows, k] <= thresholds[i])
    _, k, threshold, low = best
    if k is None:
        return value
    for above, side in ((False, low), (True, ~low)):
        rule = (*path, (k, above, threshold))
        found.append(rule)
        value[side] = _grow(x, cuts, grad, hess, rows[side], rule, depth - 1, found)
    return value


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rng: np.random.Generator) -> list[tuple[Condition, ...]]:
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 40))) for k in range(x.shape[1])]
    z, found = np.zeros(len(y)), []
    for _ in range(trees):
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        usable = [c if rng.random() < 0.7 else c[:0] for c in cuts]
        p = sigmoid(z)
        made: list = []
        _grow(x, usable, p - y, p * (1 - p), rows, (), depth, made)
        found += made
        z += 0.3 * _tree_values(x, made, p - y, p * (1 - p), rows)
    return list(dict.fromkeys(_simplified(r) for r in found))


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for k, above, threshold in rule:
        ok &= (x[:, k] > threshold) if above else (x[:, k] <= threshold)
    return ok


def _tree_values(x, rules, grad, hess, rows) -> np.ndarray:
    """Newton step of the deepest rule that holds for each row."""
    out = np.zeros(len(x))
    for rule in sorted(rules, key=len):
        ok = holds(x, rule)
        inside = rows[ok[rows]]
        out[ok] = -grad[inside].sum() / (hess[inside].sum() + 1.0)
    return out


def _simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The tightest condition of each statistic and side, in order."""
    tight: dict[tuple[int, bool], float] = {}
    for k, above, threshold in rule:
        old = tight.get((k, above))
        tight[k, above] = threshold if old is None else (max if above else min)(old, threshold)
    return tuple((k, above, t) for (k, above), t in sorted(tight.items()))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the bias isn't penalised."""
    n, m = a.shape
    centre = a.mean(axis=0)
    b = a - centre
    lip = 0.25 * (np.linalg.norm(b, 2) ** 2 / n + 1)
    w, bias = np.zeros(m), 0.0
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        err = sigmoid(b @ v + vb) - y
        step = v - (b.T @ err) / n / lip
        new = np.sign(step) * np.maximum(np.abs(step) - penalty / lip, 0)
        new_bias = vb - err.mean() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return float(bias - centre @ w), w


def train(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3,
          penalties: tuple[float, ...] = (0.02, 0.005, 0.0015, 0.0005), seed: int = 11) -> Rules:
    if len(set(y.tolist())) < 2:
        return Rules(names)
    rng = np.random.default_rng(seed)
    rules = boosted_rules(x, y, trees, depth, rng)
    if not rules:
        return Rules(names)
    a = np.stack([holds(x, r) for r in rules], axis=1).astype(np.float64)
    a, first = np.unique(a, axis=1, return_index=True)       # rules that hold for the same rows count once
    rules = [rules[i] for i in first]
    test = rng.random(len(y)) < 0.25
    if len(set(y[~test].tolist())) < 2 or not test.any():
        test[:] = False

    def loss(fit):
        p = np.clip(sigmoid(a[test] @ fit[1] + fit[0]), 1e-6, 1 - 1e-6)
        return -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()

    penalty = min(penalties, key=lambda s: loss(lasso_logistic(a[~test], y[~test], s))) if test.any() else penalties[1]
    bias, w = lasso_logistic(a, y, penalty)
    return Rules(names, bias, [(rules[i], float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-4)])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", rows_per_class: int = 3000) -> Rules:
    """Fit on at most ``rows_per_class`` labelled rows of each class: the ids of smallest hash where ``learn``."""
    drawn = labelled_sample(labels, learn, label_col, id_col, rows_per_class)
    rows, names = with_statistics(id_and_text(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id"))
    got = sorted(tuple(r) for r in rows.select("doc_id", "label", *names).collect())      # bounded by the parameter
    data = np.array([r[1:] for r in got], dtype=np.float64).reshape(len(got), 1 + len(names))
    return train(data[:, 1:], data[:, 0], names)


def score(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    rows, _ = with_statistics(id_and_text(docs, id_col, text_col))
    return rows.select("doc_id", rules.column().alias("score"))
