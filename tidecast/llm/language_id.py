"""Language ID: cross-parsing entropy over suffix automata.

For each language a suffix automaton of labelled text accepts exactly that
text's substrings.  A document is parsed against each: a phrase is the longest
match that starts where the last one ended, so the phrase count times the log
of the training length is a cross-entropy estimate.  Languages keep training texts of
their own lengths.  To the length come the codes of the alphabet, as if each stood once before the
text: so a text of a few letters costs no less than plain spelling, and the
language of least cost wins.

Automata are turned into dense tables, and documents into fixed-length
segments (a phrase ends where its segment ends, alike for all languages), so a
task walks thousands of segments at once.  Only the training text, of bounded
length, is sent to tasks; each worker builds its automata once.

Training takes ``rows_per_lang`` labelled rows (those of smallest hash) and keeps at
most ``train_chars`` characters per language.  Labelled text may contain
other languages, so each half of the rows is first parsed with automata of the other
half, and chunks that another language parses better are left out.

Defined results: ``und`` with score 0 for a null text, an empty text and a text
without letters; equal costs go to the first language in order; with no
labelled rows every text is ``und``; null ids and repeated rows get a row
each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, id_and_text, tidy
from .packing import slices_by_size

UNKNOWN = "und"
SEGMENT = 256
#: Codes of a table: 0 is any run of other characters, 1 a letter not in the training text, 2 the padding.
SEPARATOR, UNSEEN, PAD = 0, 1, 2
#: Up to SINGLES letters have a code each, else the MOST_USED most used ones; that bounds the tables' width.
SINGLES, MOST_USED = 250, 64
MISS = np.int32(-2**31)


class LetterCodes:
    """Characters -> small codes; upper and lower case alike.  Of more than ``SINGLES``
    letters the ``MOST_USED`` most used ones have a code each, any other is a pair of codes, one of
    its row and one of its column in a square; none of these codes means anything else."""

    def __init__(self, texts: list[str]):
        count = Counter(c for t in texts for c in t.lower() if c.isalpha())
        letters = sorted(count)
        if len(letters) > SINGLES:
            letters = sorted(sorted(letters, key=lambda c: (-count[c], c))[:MOST_USED])
        pairs = sorted(count.keys() - set(letters))
        self.rows = 3 + len(letters)                          # the first code of a row; columns follow rows
        self.side = math.isqrt(len(pairs) - 1) + 1 if pairs else 0
        self.size = self.rows + 2 * self.side
        codes = {c: i + 3 for i, c in enumerate(letters)} | {c: self.size + i for i, c in enumerate(pairs)}
        table = np.full(0x110000, SEPARATOR, dtype=np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = codes.get(c.lower(), UNSEEN)
        self.table = table

    def of(self, text: str) -> np.ndarray:
        codes = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        if len(codes) > 1:
            same = np.empty(len(codes), dtype=bool)
            same[0] = True
            np.logical_or(codes[1:] != SEPARATOR, codes[:-1] != SEPARATOR, out=same[1:])
            codes = codes[same]
        pair = codes >= self.size
        if pair.any():
            at = np.flatnonzero(pair)
            nth, at = codes[at] - self.size, at + np.arange(len(at))
            codes = np.repeat(codes, 1 + pair)
            codes[at] = self.rows + nth // self.side
            codes[at + 1] = self.rows + self.side + nth % self.side
        return codes


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``; state 0 is its root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        state = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = state
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                split = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = split
                    p = link[p]
                link[q] = link[state] = split
        last = state
    return go


def parse_table(codes: np.ndarray, alphabet: int) -> np.ndarray:
    """Dense walk table: entry (state, code) is the next state's row offset;
    where no longer match exists, the match restarts and the top bit is set.
    A letter that the training text lacks is a phrase of its own: it leads to
    a state from which nothing matches."""
    go = suffix_automaton(codes.tolist())
    nowhere = len(go)
    first = np.full(alphabet, nowhere * alphabet, dtype=np.int32)
    for c, s in go[0].items():
        first[c] = s * alphabet
    table = np.tile(first | MISS, (len(go) + 1, 1))
    table[0] = first
    for state, nexts in enumerate(go):
        for c, s in nexts.items():
            table[state, c] = s * alphabet
    table[:, PAD] = np.arange(len(go) + 1, dtype=np.int32) * alphabet
    return table.reshape(-1)


class CrossParser:
    def __init__(self, training: dict[str, str]):
        self.langs = sorted(training)
        self.letters = LetterCodes(list(training.values()))
        codes = [self.letters.of(training[lang]) for lang in self.langs]
        self.tables = [parse_table(c, self.letters.size) for c in codes]
        self.cost = np.array([np.log(len(c) + self.letters.size) for c in codes])      # of a phrase

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters of each text, phrases by text and language)."""
        codes = [self.letters.of(t) for t in texts]
        letters = np.array([int((c != SEPARATOR).sum()) for c in codes], dtype=np.int64)
        segments = np.array([-(-len(c) // SEGMENT) for c in codes], dtype=np.int64)
        ends = np.cumsum(segments)
        total = int(ends[-1]) if len(ends) else 0
        grid = np.full(total * SEGMENT, PAD, dtype=np.int32)
        for c, end, n in zip(codes, ends, segments):
            grid[(end - n) * SEGMENT:(end - n) * SEGMENT + len(c)] = c
        steps = np.ascontiguousarray(grid.reshape(total, SEGMENT).T)
        counts = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), segments)
        for k, table in enumerate(self.tables):
            state = np.zeros(total, dtype=np.int32)
            missed = np.zeros(total, dtype=np.int32)
            for row in steps:
                state += row
                state = table.take(state)
                missed -= state >> 31
                state &= 0x7FFFFFFF
            counts[:, k] = np.bincount(owner, weights=missed + 1, minlength=len(texts))
        return letters, counts

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language of least cost; score: by how much of the next one's cost it is cheaper."""
        letters, counts = self.phrases(texts)
        if not self.langs:
            return [UNKNOWN] * len(letters), np.zeros(len(letters))
        costs = counts * self.cost
        best = costs.argmin(axis=1)
        ordered = np.sort(costs, axis=1)
        second = ordered[:, 1] if len(self.langs) > 1 else (np.maximum(letters, 1) + 1) * self.cost[0]
        score = np.where(letters > 0, np.clip(1 - ordered[:, 0] / np.maximum(second, 1), 0, 1), 0.0)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters)], score


def chunks(text: str, size: int = 400) -> list[str]:
    return [text[i:i + size] for i in range(0, len(text), size)]


def training_text(rows: list[tuple[str, str]], train_chars: int) -> dict[str, str]:
    """At most ``train_chars`` characters of text per language from labelled rows, foreign chunks left out."""
    halves: list[dict[str, list[list[str]]]] = [{}, {}]
    nth: dict[str, int] = {}
    for lang, text in sorted(rows):
        n = nth[lang] = nth.get(lang, -1) + 1
        halves[n % 2].setdefault(lang, []).append(chunks(text))

    def mixed(of: dict[str, list[list[str]]]) -> dict[str, str]:
        """The rows' chunks in turn."""
        texts = {}
        for lang, docs in of.items():
            turns = [d[i] for i in range(max(map(len, docs), default=0)) for d in docs if i < len(d)]
            texts[lang] = " ".join(turns)[:train_chars]
        return {lang: t for lang, t in texts.items() if t}

    cleaned: dict[str, list[list[str]]] = {}
    for own, other in ((halves[0], halves[1]), (halves[1], halves[0])):
        parser = CrossParser(mixed(other))
        for lang, docs in own.items():
            for doc in docs:
                if lang in parser.langs and len(parser.langs) > 1 and doc:
                    langs, _ = parser.decide(doc)
                    doc = [c for c, found in zip(doc, langs) if found in (lang, UNKNOWN)]
                if doc:
                    cleaned.setdefault(lang, []).append(doc)
    return mixed(cleaned)


def fit(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        rows_per_lang: int = 64, train_chars: int = 40_000) -> dict[str, str]:
    """Training text by language from a bounded sample of the rows where ``learn``."""
    rows = docs.where(learn).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.xxhash64(F.col(f"`{id_col}`")).alias("draw"))
    rows = rows.where("lang is not null and text is not null and length(text) > 0")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    drawn = rows.withColumn("nth", nth).where(F.col("nth") <= rows_per_lang)
    return training_text([(r["lang"], r["text"]) for r in drawn.select("lang", "text").collect()], train_chars)


PREDICTIONS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(training: dict[str, str]):
    key = hash(tuple(sorted(training.items())))

    def run(batches):
        parser = held(("languages", key), lambda: CrossParser(training))
        for whole in batches:
            for batch in slices_by_size(whole, "text"):
                langs, score = parser.decide([t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], schema=PREDICTIONS)
    return tidy(run)


def identify(docs: DataFrame, training: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_predict(training), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, training: dict[str, str], text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that have a language (and at least ``min_score``), all
    columns; rows aren't shuffled or joined."""
    key = hash(tuple(sorted(training.items())))

    def run(batches):
        parser = held(("languages", key), lambda: CrossParser(training))
        for whole in batches:
            for batch in slices_by_size(whole, text_col):
                langs, score = parser.decide([t or "" for t in batch.column(text_col).to_pylist()])
                yield batch.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in zip(langs, score)], pa.bool_()))
    return docs.mapInArrow(tidy(run), docs.schema)
