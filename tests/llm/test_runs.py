import hashlib
import random
import zlib

import numpy as np
import pytest

from tidecast.llm.periodic_runs import find_runs, periodic_runs
from tidecast.llm.queries import QUERIES

from .helpers import WORD, awkward, empty

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """Every diagonal word by word; of equal stretches the smallest lag."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("least", [2, 5, 12, 20])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(250):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            letters, n = rng.choice([1, 2, 3, 50]), rng.randrange(0, 130)
            words = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
                for _ in range(rng.randrange(3)):
                    words[rng.randrange(n)] = rng.randrange(letters)
            docs.append(words)
        docs.append([bin(i).count("1") & 1 for i in range(128)])        # no stretch three times in a row
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = find_runs(np.array([w for d in docs for w in d], dtype=np.int64), bounds, least)
        want = sorted((int(s + bounds[i]), n, q) for i, d in enumerate(docs) for s, n, q in brute_runs(d, least))
        assert [tuple(r) for r in got.tolist()] == want


def test_long_periodic_texts_stay_linear():
    for words in (np.zeros(300_000, np.int64), np.arange(300_000) % 7, np.tile(np.r_[np.zeros(999, np.int64), 1], 300)):
        runs = find_runs(words, np.array([0, len(words)]))
        assert [0, len(words), len(np.unique(words)) if words[999] != 1 else 1000] in runs.tolist()


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((repr(r["doc_id"]), r["collapsed"], [tuple(x) for x in r["runs"]]) for r in periodic_runs(docs).collect())
    words = [WORD.findall(t or "") for _, t in rows]
    short = {w: brute_runs(w) for w in map(tuple, words) if len(w) < 1_000}
    want = sorted((repr(d), collapse(w, short.get(tuple(w), [])), short.get(tuple(w), [])) for (d, _), w in zip(rows, words))
    assert got == want
    assert periodic_runs(empty(spark)).count() == 0


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    sha, planted = (lambda s: hashlib.sha256(s.encode()).hexdigest()), 0
    for d, text in docs:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(d).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 3_000:
            continue
        runs = brute_runs(words)
        top = min(((-m, s, q) for s, m, q in runs), default=None)
        best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
        assert got[d] == (len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapse(words, runs)))
    assert planted > 10
