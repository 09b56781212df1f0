import numpy as np
import pytest
from pyspark.sql import functions as F

import tidecast.llm.language_id as lang
import tidecast.llm.rule_ensemble as rules
import tidecast.llm.toxicity as tox
from tidecast.llm.common import labelled_sample
from tidecast.llm.queries import QUERIES

from .helpers import awkward, empty

SF = "/root/testdata/sf0.1"


def test_automaton_walk_is_cross_parsing():
    rng = np.random.default_rng(0)
    training = {k: "".join(rng.choice(list("abcd "), 300)) for k in ("p", "q")}
    parser = lang.CrossParser(training)
    texts = ["".join(rng.choice(list("abcde "), n)) for n in (0, 1, 5, 200, lang.SEGMENT, lang.SEGMENT + 1)]
    _, counts = parser.phrases(texts)
    for t, row in zip(texts, counts):
        codes = parser.letters.of(t).tolist()
        for k, name in enumerate(parser.langs):
            own = parser.letters.of(training[name]).tolist()
            n = 0
            for s in range(0, len(codes), lang.SEGMENT):
                part, at = codes[s:s + lang.SEGMENT], 0
                while at < len(part):
                    end = at + 1
                    while end < len(part) and any(own[i:i + end + 1 - at] == part[at:end + 1] for i in range(len(own))):
                        end += 1
                    at, n = end, n + 1
            assert row[k] == n


def test_language_id(spark):
    got = QUERIES["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.99 and held[1] >= 0 and held[2] <= 1


@pytest.mark.parametrize("stray", ["abc", " "])
def test_language_with_next_to_no_text_shortens_no_other(spark, stray):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    training = lang.fit(docs.unionByName(spark.createDataFrame([(-1, stray, "aa")], docs.schema)), F.lit(True))
    assert training["aa"] == stray and min(len(t) for k, t in training.items() if k != "aa") > 1000
    got = lang.identify(docs, training).join(docs.where("lang is not null and length(text) > 0").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_languages_of_many_letters(spark):
    rng = np.random.default_rng(5)
    spans = {"el": (0x3B1, 24), "en": (97, 26), "ja": (0x3041, 80), "ru": (0x430, 32), "th": (0xE01, 40), "hi": (0x905, 50),
             "ko": (0xAC00, 900), "zh": (0x4E00, 1500)}            # code points of Korean and Chinese come after the 250th letter

    def text(k, n):                                           # few of a span's letters make most of a text
        first, many = spans[k]
        return "".join(chr(first + int(many * x ** 3)) if y else " " for x, y in zip(rng.random(n), rng.random(n) > 0.1))

    rows = [(i, text(k, 2_000), k) for i, k in enumerate([*spans] * 6)]
    training = lang.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert sorted(training) == sorted(spans)
    given = {i: k for i, k in enumerate([*spans] * 3)}
    held = spark.createDataFrame([(i, text(k, 100)) for i, k in given.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in lang.identify(held, training).collect()} == given
    codes = lang.LetterCodes(list(training.values()))
    letters = sorted({c for t in training.values() for c in t if c != " "})
    assert len({codes.of(c).tobytes() for c in letters}) == len(letters) > lang.SINGLES and codes.size < 256


def test_language_awkward(spark):
    docs = awkward(spark)
    training = {"en": "the cat and the dog of alpha beta gamma", "fr": "le chat et le chien de la maison noire de"}
    got = {(r["doc_id"], r["lang_pred"]) for r in lang.identify(docs, training).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (None, "und"), (8, "en")} <= got
    kept = lang.keep_identified(docs, training)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    assert {r["lang_pred"] for r in lang.identify(docs, {}).collect()} == {"und"}
    assert lang.identify(empty(spark), training).count() == 0
    assert lang.fit(empty(spark), F.lit(True)) == {} and lang.fit(docs, F.lit(True)) == {}


def test_toxicity_gradients():
    rng = np.random.default_rng(2)
    model = {k: v.astype(np.float64) for k, v in tox.new_model(rng).items()}
    vectors = rng.standard_normal((9, 2 * tox.DIM))
    ids = rng.integers(0, 9, (5, 7))
    real = np.ones((7, 5))
    real[5:, 0] = 0
    label = np.array([0, 1, 1, 0, 1.0])

    def loss():
        logit = tox.forward(model, tox.spread(tox.input_sums(model, vectors), ids), real)
        p = tox.sigmoid(logit.astype(np.float64))
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    g, d_vectors, _ = tox.gradients(model, vectors, ids, real, label)
    for name in ("inp", "rec", "bias", "att", "out", "shift"):
        flat = model[name].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(np.asarray(g[name]).reshape(-1)[i], abs=2e-3)
    assert np.isfinite(d_vectors).all()


def test_windows_cover_the_text():
    for n in range(0, 400):
        starts = tox.window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + tox.WINDOW))}
        assert covered == set(range(n))
        assert all(b - a <= tox.STRIDE for a, b in zip(starts, starts[1:]))


def accuracy(spark, name, label, cut):
    got = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, s = got[label].to_numpy(), got["score"]
    assert ((s >= 0) & (s <= 1)).all() and (got["predicted"] == (s >= cut)).all()
    rank = s.rank().to_numpy()
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)), (got["predicted"] == y).mean()


def test_toxicity(spark):
    auc, right = accuracy(spark, "op2_toxicity", "toxic", 0.7)
    assert auc > 0.93 and right > 0.95


def test_quality(spark):
    auc, right = accuracy(spark, "op9_rule_ensemble", "quality", 0.3)
    assert auc > 0.98 and right > 0.97


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    assert {r["score"] for r in tox.score(docs, None).collect()} == {0.0}
    model = tox.train(["you stupid loser " * 4, "a fine day " * 6] * 20, [1, 0] * 20, epochs=2)
    got = {r["doc_id"]: r["score"] for r in tox.score(docs, model).collect()}
    assert len(got) == 13 and got[1] == got[2] == got[3] == 0 and all(0 <= s <= 1 for s in got.values())
    assert tox.score(empty(spark), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert tox.fit(docs, labels, F.lit(True)) is None
    assert rules.fit(docs, labels, F.lit(True)).rules == []


@pytest.mark.parametrize("k", [1, 7, 200, 100_000])
def test_labelled_sample_is_the_smallest_hashes(spark, k):
    """Two classes of unequal size, repeated and null ids, other labels; no class is ranked whole."""
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, 1).when(F.col("id") % 50 == 1, 2).otherwise(0).alias("toxic"))
    labels = ids.union(ids.where("doc_id < 500")).union(spark.createDataFrame([(None, 1), (7, None), (60_000, 1)], "doc_id long, toxic int"))
    learn = F.col("doc_id") % 3 != 1
    drawn = labelled_sample(labels, learn, "toxic", "doc_id", k)
    rows = labels.where(learn).where("doc_id is not null and toxic in (0, 1)").distinct().withColumn("h", F.xxhash64("doc_id")).collect()
    want = {(r["doc_id"], c) for c in (0, 1) for r in sorted((r for r in rows if r["toxic"] == c), key=lambda r: r["h"])[:k]}
    got = [tuple(r) for r in drawn.collect()]
    assert set(got) == want and len(got) == len(want)
    if k == 200:
        ranked = labels.where(learn).select(F.xxhash64("doc_id").alias("h"), "toxic").where("toxic = 0").distinct()
        bound = max(r["h"] for r in rows if (r["doc_id"], 0) in want)
        assert ranked.where(F.shiftright("h", 48) <= bound >> 48).count() < 2 * k
    assert labelled_sample(labels.limit(0), learn, "toxic", "doc_id", k).count() == 0


def plain_logit(model, words):
    """One window's logit, word by word in double precision; padding is the empty word."""
    inputs = tox.word_inputs(model, tox.features(words + [""] * (tox.WINDOW - len(words)))).astype(float)
    h_size, states = tox.HIDDEN, {}
    for d in (0, 1):
        h = np.zeros(h_size)
        for t in (range(tox.WINDOW) if d == 0 else range(tox.WINDOW - 1, -1, -1)):
            x = model["inp"][d].astype(float) @ inputs[t] + model["bias"][d][:, 0]
            rec = model["rec"][d].astype(float) @ h
            z, r = (rules.sigmoid(x[i * h_size:(i + 1) * h_size] + rec[i * h_size:(i + 1) * h_size]) for i in (0, 1))
            h = z * h + (1 - z) * np.tanh(x[2 * h_size:] + r * rec[2 * h_size:])
            states[t, d] = h
    weight = np.array([np.exp(sum(model["att"][d] @ states[t, d] for d in (0, 1))) for t in range(len(words))])
    weight /= weight.sum()
    return sum(w * sum(model["out"][d] @ states[t, d] for d in (0, 1)) for t, w in enumerate(weight)) + model["shift"][0]


def test_scores_equal_window_by_window_passes():
    rng = np.random.default_rng(3)
    model = tox.new_model(rng)
    model["bias"] += rng.standard_normal(model["bias"].shape).astype(np.float32) * 0.3
    model["curve"] = np.array([2.5, 0.1])
    vocabulary = ["w" + str(i) for i in range(90)] + ["STUPID!", "é", "x" * 95]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 40, 63, 64, 65, 96, 97, 300)] + ["", " \n "]
    got = tox.Scorer(model).scores(texts, at_once=7)
    for text, score in zip(texts, got):
        words = tox.words_of(text)
        top = [plain_logit(model, words[s:s + tox.WINDOW]) for s in tox.window_starts(len(words))]
        assert score == pytest.approx(rules.sigmoid(2.5 * (max(top) - 0.1)) if top else 0.0, abs=1e-5)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(5)
    a = (rng.random((500, 30)) < 0.3).astype(float)
    y = (rng.random(500) < rules.sigmoid(2 * a[:, 0] - 3 * a[:, 1] + a[:, 2])).astype(float)
    for penalty in (0.02, 0.005):
        bias, w = rules.lasso_logistic(a, y, penalty, rounds=4000)
        error = rules.sigmoid(a @ w + bias) - y
        slope = a.T @ error / len(y)
        assert abs(error.mean()) < 1e-5
        assert np.abs(slope[w != 0] + penalty * np.sign(w[w != 0])).max() < 1e-5 and (np.abs(slope[w == 0]) <= penalty + 1e-5).all()
        assert 0 < (w != 0).sum() < 30


def test_split_is_the_best_of_all():
    rng = np.random.default_rng(8)
    for _ in range(20):
        x, grad, hess = rng.random((60, 3)).round(1), rng.standard_normal(60), rng.random(60) + 0.1
        cuts = [np.unique(x[:, k]) for k in range(3)]
        found: list = []
        rules._grow(x, cuts, grad, hess, np.arange(60), (), 1, found)

        def gain(k, cut):
            low = x[:, k] <= cut
            if min(low.sum(), (~low).sum()) < 5:
                return -np.inf
            return sum(grad[s].sum() ** 2 / (hess[s].sum() + 1) for s in (low, ~low)) - grad.sum() ** 2 / (hess.sum() + 1)

        best = max(gain(k, c) for k in range(3) for c in cuts[k])
        if best > 1e-6:
            assert [above for ((_, above, _),) in found] == [False, True]
            assert gain(found[0][0][0], found[0][0][2]) == pytest.approx(best)
        else:
            assert not found


def test_compiled_rules_equal_numpy(spark):
    docs = awkward(spark)
    rows, names = rules.with_statistics(docs.select("doc_id", "text"))
    x = np.array([tuple(r) for r in rows.select(*names).collect()], dtype=np.float64)
    assert np.isfinite(x).all()
    rng = np.random.default_rng(0)
    sample = rng.random((400, len(names)))
    fitted = rules.train(sample, ((sample[:, 2] > 0.4) & (sample[:, 5] < 0.7)).astype(float), names)
    assert fitted.rules
    got = np.array([r["score"] for r in rules.score(docs, fitted).collect()])
    want = rules.sigmoid(fitted.bias + sum(w * rules.holds(x, rule) for rule, w in fitted.rules))
    assert np.allclose(got, want) and len(got) == docs.count()
    assert rules.score(empty(spark), fitted).count() == 0
    assert {r["score"] for r in rules.score(docs, rules.Rules(names)).collect()} == {0.5}
