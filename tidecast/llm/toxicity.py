"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word's input is a learned word vector (hashed) next to the mean of learned
vectors of its character 2- to 5-grams (hashed).  Words go through a forward
and a backward gated recurrent layer, attention pools their states, and a
logistic unit scores the window.  Training is numpy with hand-written
gradients on a bounded sample; a toxic document teaches by the window that the
network finds most toxic, as labels don't say where the toxic words are.

Every overlapping window of the whole text is scored; the largest window
score is the document's, mapped to 0..1 by a logistic curve fitted to training
documents.  In tasks the input layer is a row look-up per distinct word.

Defined results: null, empty and blank texts score 0; null ids and repeated rows
get a row each; with no labelled rows of both classes every text scores 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, labelled_sample, tidy
from .packing import slices_by_size

WINDOW, STRIDE = 64, 32
WORD_ROWS, GRAM_ROWS = 8192, 16384
DIM, HIDDEN = 8, 8
NGRAMS = (2, 3, 4, 5)
PIECE = 40                   # longer runs without a blank count as several words
KEPT_WORDS = 150_000


# --- inputs ---------------------------------------------------------------

def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if words and len(max(words, key=len)) > PIECE:
        words = [w[i:i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row, n-gram rows of all words in turn, n-grams per word)."""
    bare = [w.strip(".,;:!?\"'()[]{}*#$%&-_") for w in words]
    rows = np.array([crc32(w.encode("utf-8", "surrogatepass")) % WORD_ROWS for w in bare], dtype=np.int64)
    marked = ["\x02" + w + "\x03" for w in bare]
    lengths = np.array([len(m) for m in marked], dtype=np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes))
    grams, owners = [], []
    rolling = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        shifted = np.zeros(len(codes), dtype=np.uint64)
        shifted[:max(0, len(codes) - n + 1)] = codes[n - 1:]
        rolling = (rolling * np.uint64(1_000_003) + shifted) & np.uint64(0xFFFFFFFF)
        if n in NGRAMS:
            inside = at + n <= ends
            mixed = rolling[inside] * np.uint64(2_654_435_761) + np.uint64(n)
            grams.append(((mixed >> np.uint64(15)) % np.uint64(GRAM_ROWS)).astype(np.int64))
            owners.append(owner[inside])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows, grams[order], np.bincount(owners, minlength=len(words))


def word_inputs(model: dict, feats) -> np.ndarray:
    """Input vectors of words: word vector next to the mean n-gram vector."""
    rows, grams, counts = feats
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    mean = np.add.reduceat(model["gram"][grams], starts, axis=0) / np.maximum(counts, 1)[:, None]
    return np.concatenate([model["word"][rows], mean], axis=1).astype(np.float32)


def window_starts(n: int) -> list[int]:
    """Overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


# --- network --------------------------------------------------------------

def new_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def draw(*shape, scale=0.1):
        return (rng.standard_normal(shape) * scale).astype(np.float32)
    return {"word": draw(WORD_ROWS, DIM), "gram": draw(GRAM_ROWS, DIM, scale=0.2),
            "inp": draw(2, 3 * HIDDEN, 2 * DIM, scale=0.4), "rec": draw(2, 3 * HIDDEN, HIDDEN, scale=0.3),
            "bias": np.zeros((2, 3 * HIDDEN, 1), np.float32), "att": draw(2, HIDDEN, scale=0.3),
            "out": draw(2, HIDDEN, scale=0.5), "shift": np.zeros(1, np.float32)}


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def forward(model: dict, inputs: np.ndarray, real: np.ndarray, keep: bool = False):
    """Logits of windows.  inputs: (T, 2, 3H, B), the input layer's sums with
    the backward direction already in reversed word order; real: (T, B) words."""
    steps, _, _, n = inputs.shape
    h = np.zeros((2, HIDDEN, n), np.float32)
    states = np.empty((steps, 2, HIDDEN, n), np.float32)
    kept = []
    for t in range(steps):
        rec = model["rec"] @ h
        gates = inputs[t, :, :2 * HIDDEN] + rec[:, :2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        cand = np.tanh(inputs[t, :, 2 * HIDDEN:] + r * rec[:, 2 * HIDDEN:])
        if keep:
            kept.append((h, z, r, cand, rec[:, 2 * HIDDEN:]))
        h = cand + z * (h - cand)
        states[t] = h
    both = np.concatenate([states[:, :1], states[::-1, 1:]], axis=1)     # (T, 2, H, B) in word order
    weight = np.exp(np.einsum("tdhb,dh->tb", both, model["att"], optimize=True)) * real
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tdhb,tb->dhb", both, weight, optimize=True)
    logit = np.einsum("dhb,dh->b", pooled, model["out"], optimize=True) + model["shift"][0]
    return (logit, both, weight, pooled, kept) if keep else logit


def input_sums(model: dict, vectors: np.ndarray) -> np.ndarray:
    """Input layer of word vectors: (words, 2 * 3H)."""
    layer = model["inp"].reshape(6 * HIDDEN, 2 * DIM)
    return vectors @ layer.T + model["bias"].reshape(1, 6 * HIDDEN)


def spread(sums: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(T, 2, 3H, B) inputs of windows of word rows (B, T)."""
    ahead = sums[:, :3 * HIDDEN][ids.T]
    back = sums[:, 3 * HIDDEN:][ids.T[::-1]]
    out = np.empty((ids.shape[1], 2, 3 * HIDDEN, ids.shape[0]), np.float32)
    out[:, 0] = ahead.transpose(0, 2, 1)
    out[:, 1] = back.transpose(0, 2, 1)
    return out


def gradients(model: dict, vectors: np.ndarray, ids: np.ndarray, real: np.ndarray, label: np.ndarray):
    """Gradients of the mean logistic loss; vectors: inputs of the rows that ids (B, T) name."""
    sums = input_sums(model, vectors)
    inputs = spread(sums, ids)
    logit, both, weight, pooled, kept = forward(model, inputs, real, keep=True)
    n, steps = ids.shape
    err = ((sigmoid(logit) - label) / n).astype(np.float32)
    g = {"out": np.einsum("dhb,b->dh", pooled, err), "shift": err.sum(keepdims=True)}
    d_pool = model["out"][:, :, None] * err
    d_weight = np.einsum("tdhb,dhb->tb", both, d_pool, optimize=True)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["att"] = np.einsum("tdhb,tb->dh", both, d_score, optimize=True)
    d_both = weight[:, None, None] * d_pool + d_score[:, None, None] * model["att"][:, :, None]
    d_states = np.concatenate([d_both[:, :1], d_both[::-1, 1:]], axis=1)
    g["rec"] = np.zeros_like(model["rec"])
    d_inputs = np.empty_like(inputs)
    d_h = np.zeros((2, HIDDEN, n), np.float32)
    back = model["rec"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, z, r, cand, rec_c = kept[t]
        d_h = d_h + d_states[t]
        d_cand = d_h * (1 - z) * (1 - cand * cand)
        d_z = d_h * (h - cand) * z * (1 - z)
        d_r = d_cand * rec_c * r * (1 - r)
        d_inputs[t] = np.concatenate([d_z, d_r, d_cand], axis=1)
        d_rec = np.concatenate([d_z, d_r, d_cand * r], axis=1)
        g["rec"] += d_rec @ h.transpose(0, 2, 1)
        d_h = d_h * z + back @ d_rec
    d_sums = np.zeros_like(sums)
    np.add.at(d_sums[:, :3 * HIDDEN], ids.T, d_inputs[:, 0].transpose(0, 2, 1))
    np.add.at(d_sums[:, 3 * HIDDEN:], ids.T[::-1], d_inputs[:, 1].transpose(0, 2, 1))
    g["inp"] = (d_sums.T @ vectors).reshape(model["inp"].shape)
    g["bias"] = d_sums.sum(axis=0).reshape(model["bias"].shape)
    d_vectors = d_sums @ model["inp"].reshape(6 * HIDDEN, 2 * DIM)
    return g, d_vectors, logit


# --- training -------------------------------------------------------------

class Adam:
    def __init__(self, model, rate):
        self.rate, self.step = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.items()}

    def update(self, model, grads):
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            model[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def _subset(feats, starts: np.ndarray, use: np.ndarray):
    """Features of some words."""
    rows, grams, counts = feats
    n = counts[use]
    first = np.repeat(starts[use] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return rows[use], grams[first + np.arange(int(n.sum()))], n


def train(texts: list[str], labels: list[int], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> dict | None:
    """A model, or None without both classes."""
    docs = [(words_of(t), y) for t, y in zip(texts, labels)]
    docs = [(w, y) for w, y in docs if w]
    if len({y for _, y in docs}) < 2:
        return None
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], dtype=np.int64) for w, _ in docs]
    label = np.array([y for _, y in docs], dtype=np.float32)
    feats = features(["", *vocabulary])                      # row 0: padding
    starts = np.concatenate([[0], np.cumsum(feats[2])[:-1]])
    windows = [window_starts(len(d)) for d in ids]
    rng = np.random.default_rng(seed)
    model = new_model(rng)
    adam = Adam(model, rate)

    def cut(i: int, at: int):
        row = np.zeros(WINDOW, dtype=np.int64)
        part = ids[i][at:at + WINDOW]
        row[:len(part)] = part
        return row

    for epoch in range(epochs):
        chosen = [int(rng.choice(w)) for w in windows]
        if epoch:                                            # the hardest window of each document
            best = _best_windows(model, feats, ids, windows)
            chosen = [best[i] if label[i] or rng.random() < 0.5 else c for i, c in enumerate(chosen)]
        order = rng.permutation(len(docs))
        for k in range(0, len(order), batch):
            take = order[k:k + batch]
            rows = np.stack([cut(i, chosen[i]) for i in take])
            used, local = np.unique(rows, return_inverse=True)
            sub = _subset(feats, starts, used)
            vectors = word_inputs(model, sub)
            mask = (rng.random(len(used)) > 0.3).astype(np.float32)[:, None]    # some words by their characters alone
            vectors[:, :DIM] *= mask
            g, d_vectors, _ = gradients(model, vectors, local.reshape(rows.shape), (rows > 0).T.astype(np.float32), label[take])
            g["word"] = np.zeros_like(model["word"])
            np.add.at(g["word"], sub[0], d_vectors[:, :DIM] * mask)
            g["word"] += 1e-4 * model["word"]
            g["gram"] = np.zeros_like(model["gram"])
            np.add.at(g["gram"], sub[1], np.repeat(d_vectors[:, DIM:] / np.maximum(sub[2], 1)[:, None], sub[2], axis=0))
            adam.update(model, g)
            if epoch == epochs - 2:
                adam.rate = rate / 4
    scores = _document_logits(model, feats, ids, windows)
    model["curve"] = np.array(_logistic_curve(scores, label), dtype=np.float64)
    return model


def _scored(model, feats, ids, windows):
    sums = input_sums(model, word_inputs(model, feats))
    for at in range(0, len(ids), 100):
        part = [(i, s) for i in range(at, min(at + 100, len(ids))) for s in windows[i]]
        rows = np.zeros((len(part), WINDOW), dtype=np.int64)
        for k, (i, s) in enumerate(part):
            piece = ids[i][s:s + WINDOW]
            rows[k, :len(piece)] = piece
        yield part, forward(model, spread(sums, rows), (rows > 0).T.astype(np.float32))


def _best_windows(model, feats, ids, windows) -> list[int]:
    best = [(-np.inf, 0)] * len(ids)
    for part, logits in _scored(model, feats, ids, windows):
        for (i, s), v in zip(part, logits):
            best[i] = max(best[i], (float(v), s))
    return [s for _, s in best]


def _document_logits(model, feats, ids, windows) -> np.ndarray:
    top = np.full(len(ids), -np.inf)
    for part, logits in _scored(model, feats, ids, windows):
        np.maximum.at(top, [i for i, _ in part], logits)
    return top


def _logistic_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, centre): logistic regression of one variable, classes weighing
    alike, lightly penalised so that a perfect split keeps a finite slope."""
    w = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    centre = x.mean()
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(np.clip(a * (x - centre) + b, -30, 30))
        grad = np.array([(w * (p - y) * (x - centre)).sum() + 1e-3 * (a - 1), (w * (p - y)).sum() + 1e-4 * b])
        s = w * p * (1 - p)
        hess = np.array([[(s * (x - centre) ** 2).sum() + 1e-3, (s * (x - centre)).sum()],
                         [(s * (x - centre)).sum(), s.sum() + 1e-4]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(centre - b / a) if abs(a) > 1e-9 else 0.0


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", rows_per_class: int = 1500) -> dict | None:
    """Train on at most ``rows_per_class`` labelled rows of each class: the ids of smallest hash where ``learn``."""
    drawn = labelled_sample(labels, learn, label_col, id_col, rows_per_class)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id")     # bounded by the parameter
    got = sorted((r["doc_id"], r["text"] or "", r["label"]) for r in rows.distinct().collect())
    return train([t for _, t, _ in got], [y for _, _, y in got])


# --- scoring --------------------------------------------------------------

class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.sums = input_sums(self.model, word_inputs(self.model, features([""])))

    def rows_of(self, docs: list[list[str]]) -> list[np.ndarray]:
        new = list(set().union(*docs) - self.known.keys()) if docs else []
        if len(self.known) + len(new) > KEPT_WORDS:
            self.clear()
            new = list(set().union(*docs))
        if new:
            first = len(self.sums)
            self.sums = np.concatenate([self.sums, input_sums(self.model, word_inputs(self.model, features(new)))])
            self.known.update(zip(new, range(first, first + len(new))))
        get = self.known.__getitem__
        return [np.fromiter(map(get, d), dtype=np.int64, count=len(d)) for d in docs]

    def scores(self, texts: list[str], at_once: int = 2048) -> np.ndarray:
        ids = self.rows_of([words_of(t) for t in texts])
        starts = [window_starts(len(d)) for d in ids]
        counts = np.array([len(s) for s in starts], dtype=np.int64)
        long = np.concatenate([*ids, np.zeros(WINDOW, dtype=np.int64)])
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in ids])[:-1]]).astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), counts)
        begin = np.array([s for own in starts for s in own], dtype=np.int64) + offsets[owner]
        size = np.minimum(np.array([len(d) for d in ids], dtype=np.int64)[owner], WINDOW)
        top = np.full(len(ids), -np.inf)
        for k in range(0, len(begin), at_once):
            at = begin[k:k + at_once, None] + np.arange(WINDOW)
            real = np.arange(WINDOW) < size[k:k + at_once, None]
            rows = np.where(real, long[np.minimum(at, len(long) - 1)], 0)
            np.maximum.at(top, owner[k:k + at_once], forward(self.model, spread(self.sums, rows), real.T.astype(np.float32)))
        slope, centre = self.model["curve"]
        return np.where(np.isfinite(top), sigmoid(np.clip(slope * (np.where(np.isfinite(top), top, 0) - centre), -30, 30)), 0.0)


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(model: dict | None):
    def run(batches):
        scorer = Scorer(model) if model is not None else None
        for whole in batches:
            for batch in slices_by_size(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                got = scorer.scores(texts) if scorer else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], schema=SCORES)
    return tidy(run)


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_score(model), "doc_id long, score double")
