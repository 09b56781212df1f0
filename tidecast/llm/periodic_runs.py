"""Periodic run detection: seed-and-extend on diagonals.

A run is a stretch of consecutive words with smallest period q, of at least
max(least, 2q) words, that no neighbouring word extends.  On the diagonal of lag q
(word i against word i + q) it is a stretch of at least max(least - q, q) equal pairs:
its guaranteed overlap.

1. Lags are taken in classes [1, 8), [8, 16), [16, 32), ...  Any overlap of a class
   holds a k-gram that starts at a multiple of g, where g + k - 1 is the least
   overlap of the class.  Those k-grams are the seeds.
2. All k-grams of a text are indexed (sorted by hash and place); each seed is paired with the
   equal k-grams of the same text whose distance lies in the class.  A seed has fewer
   partners than the class has lags, so a class has fewer than 4 pairs a word, however
   often a phrase repeats: pairs stay in proportion to n log n.
3. Pairs are sorted by lag and place.  Neighbouring seeds on one diagonal overlap, so a
   chain of them is one stretch: what a chain covers is not extended again.  Only the two ends of a chain are
   extended, by fewer than g words each, by binary search over prefix hashes.
4. Stretches long enough are runs.  Runs of multiples of the smallest period cover
   the same words; the smallest stays.

A word goes if any run holds it after that run's first q words; the others,
joined by one space, are the collapsed text.  Words are runs of characters other than
blank and U+0009 to U+000D.

Texts are handled whole and a row at a time, so no row moves.  Stretches are compared by two polynomial hashes
modulo primes near 2^31 (a wrong answer needs both to collide).  Defined results: a null or
empty text has no runs and an empty collapsed text; ids are passed on as they are, null or
repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, tidy
from .packing import slices_by_size

#: The moduli are primes below 2^31, the bases any numbers below them.
PRIMES = ((2_147_483_647, 1_048_586_417), (2_147_483_629, 715_827_913))
FIRST_CLASS = 8
CHARS = 1_000_000             # of text that are searched together


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.int64)
    while len(out) < n:
        step = pow(base, len(out), prime)
        out = np.concatenate([out, out * step % prime])
    return out[:n]


class Prefixes:
    """Prefix hashes of a word sequence, to compare stretches of any length."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.tables = []
        for prime, base in PRIMES:
            power = _powers(base, prime, self.n + 1)
            total = np.zeros(self.n + 1, dtype=np.int64)
            np.cumsum((ids + 1) % prime * power[:-1] % prime, out=total[1:])
            self.tables.append((prime, power, total % prime))

    def grams(self, at: np.ndarray, k: int) -> np.ndarray:
        """62-bit hashes of the k words at each place."""
        parts = [(total[at + k] - total[at]) % prime * power[self.n - at] % prime for prime, power, total in self.tables]
        return parts[0] << 31 | parts[1]

    def equal(self, at: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Are the ``length`` words at each place those ``lag`` words later?"""
        same = np.ones(len(at), dtype=bool)
        for prime, power, total in self.tables:
            near = (total[at + length] - total[at]) % prime * power[lag] % prime
            same &= near == (total[at + lag + length] - total[at + lag]) % prime
        return same

    def longest(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, left: bool) -> np.ndarray:
        """Longest equal stretch of at most ``most`` words from each place, to the right or ending there."""
        low, high = np.zeros(len(at), dtype=np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = self.equal(at - mid if left else at, lag, mid)
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low


def lag_classes(longest: int, least: int):
    """(first lag, lag after the last, guaranteed overlap) of each class of lags up to half the longest text."""
    low, high = 1, FIRST_CLASS
    while 2 * low <= longest:
        yield low, high, low if low >= least else min(max(least - q, q) for q in range(low, high))
        low, high = high, 2 * high


def _repeats_a_gram(prefix: Prefixes, doc: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Which texts hold some k-gram twice: the others have no run."""
    at = np.arange(prefix.n)
    at = at[at + k <= ends[doc]]
    grams = prefix.grams(at, k)
    order = np.argsort(grams, kind="stable")
    grams, of = grams[order], doc[at[order]]
    found = np.zeros(len(ends), dtype=bool)
    found[of[1:][(grams[1:] == grams[:-1]) & (of[1:] == of[:-1])]] = True
    return found


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int = 12) -> np.ndarray:
    """Runs (start, length, period), sorted, of texts laid end to end: ``ids`` names their words,
    ``bounds`` says where each text starts and the last ends.  Starts count from the first text's first word."""
    sizes = np.diff(bounds)
    nothing = np.empty((0, 3), dtype=np.int64)
    if not len(ids) or sizes.max() < least:
        return nothing
    prefix = Prefixes(ids)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts, ends = bounds[:-1], bounds[1:]
    shortest = min(max(least - q, q) for q in range(1, least + 1))
    able = (sizes >= least) & _repeats_a_gram(prefix, doc, ends, shortest)
    found = [nothing]
    for low, high, overlap in lag_classes(int(sizes[able].max(initial=0)), least):
        g = max(1, overlap // 2)
        k = overlap - g + 1
        at = np.flatnonzero((able & (sizes >= 2 * low))[doc])
        at = at[at + k <= ends[doc[at]]]
        if not len(at):
            continue
        grams = prefix.grams(at, k)
        order = np.argsort(grams, kind="stable")
        at, grams = at[order], grams[order]
        new = np.concatenate([[False], grams[1:] != grams[:-1]])
        placed = np.cumsum(new) * (prefix.n + high) + at          # ascending: by gram, then by place
        seeds = np.flatnonzero(at % g == 0)
        base, place = placed[seeds], at[seeds]
        first = np.searchsorted(placed, base + low)
        n = np.searchsorted(placed, base + np.minimum(high, ends[doc[place]] - place)) - first
        first, n, place = first[n > 0], n[n > 0], place[n > 0]
        partner = at[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        place = np.repeat(place, n)
        order = np.lexsort((place, partner - place))
        place, lag = place[order], (partner - place)[order]
        if not len(place):
            continue
        linked = (lag[1:] == lag[:-1]) & (place[1:] == place[:-1] + g)
        head, tail = np.concatenate([[True], ~linked]), np.concatenate([~linked, [True]])
        lag, begin, end = lag[head], place[head], place[tail] + k
        most_left = np.minimum(g - 1, begin - starts[doc[begin]])
        most_right = np.minimum(g - 1, ends[doc[begin]] - lag - end)
        begin = begin - prefix.longest(begin, lag, most_left, left=True)
        end = end + prefix.longest(end, lag, most_right, left=False)
        long = end - begin >= np.maximum(least - lag, lag)
        found.append(np.stack([begin, end - begin + lag, lag], axis=1)[long])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    again = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
    return np.concatenate([runs[:1], runs[1:][~again]])


def _collapsed(least: int):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batches):
        for whole in batches:
            for batch in slices_by_size(whole, "text", CHARS):
                texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
                names: dict[bytes, int] = {}
                ids = np.fromiter((names.setdefault(w, len(names)) for words in texts for w in words), dtype=np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
                runs = find_runs(ids, bounds, least)
                change = np.zeros(len(ids) + 1, dtype=np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(change)[:-1] == 0
                cuts = np.searchsorted(runs[:, 0], bounds)
                rows = []
                for i, words in enumerate(texts):
                    if cuts[i] < cuts[i + 1]:
                        words = compress(words, kept[bounds[i]:bounds[i + 1]].tolist())
                    rows.append(b" ".join(words).decode())
                columns = [pa.array(runs[:, 0] - np.repeat(bounds[:-1], np.diff(cuts))), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
                listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(run_type)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed, pa.array(rows, pa.string())], schema=schema)
    return tidy(run)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """One row per input row: doc_id, runs (array of start, length, period; words from 0; by
    start, then period), collapsed (the text without the words that repeat a run's first period)."""
    if least < 2:
        raise ValueError("a run has at least two words")
    return id_and_text(docs, id_col, text_col).mapInArrow(
        _collapsed(least), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
