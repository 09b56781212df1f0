import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm.components import connected_components
from tidecast.llm.exact_dedup import drop_duplicates, exact_duplicates
from tidecast.llm.jaccard_join import Region, candidate_edges, jaccard_components, joined, sketch_width  # noqa: F401

from .helpers import LOWER, awkward, brute_components, empty, near_copies


def brute_exact(rows, best):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(text.encode()).hexdigest()) for d in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("digest", [None, "weak"])
def test_exact_duplicates(spark, keep, digest):
    docs = awkward(spark)
    extra = {} if digest is None else {"digest": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))}   # collides a lot
    got = exact_duplicates(docs, keep=keep, **extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(rows, min if keep == "min" else max)
    kept = drop_duplicates(docs, keep=keep, **extra)
    assert kept.columns == docs.columns
    texts = [(t or "").translate(LOWER) for _, t in rows]
    assert sorted((r["text"] or "").translate(LOWER) for r in kept.collect()) == sorted(set(texts))


def test_exact_empty(spark):
    assert exact_duplicates(empty(spark)).count() == 0
    assert drop_duplicates(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 200), (300, 1000), (1000, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 300: 0, 1000: 0, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path(spark):
    path = np.random.default_rng(0).permutation(5_000).tolist()     # labels that move one hop a round need over 1,000 rounds
    got = connected_components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(5_000)]


@pytest.mark.parametrize("most", [4_000_000, 3_000])           # 3000: every group is a large region of several blocks
def test_jaccard_equals_brute_force(spark, most):
    rows = near_copies()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), most_shingles=most)
    assert {tuple(r) for r in got.collect()} == brute_components(rows)


@pytest.mark.parametrize("size, percent", [(5, 80), (1, 70)])
def test_other_shingles_and_hot_pivots(spark, size, percent):
    rows = near_copies(seed=size, groups=4, copies=30)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), threshold_percent=percent, shingle_words=size, pivot_rows=7)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, percent, size)


def test_templated_sets_are_not_all_pairs():
    """Thousands of sets alike at 0.85, under the threshold: prefixes part them; linked ones are found."""
    rng = np.random.default_rng(5)
    template = rng.integers(0, 2**63, 276, dtype=np.uint64)
    sets = [np.unique(np.concatenate([template, rng.integers(0, 2**63, 24, dtype=np.uint64)])) for _ in range(3_000)]
    for k in range(0, 200, 2):                                      # pairs that differ in few shingles
        sets[k + 1] = np.unique(np.concatenate([sets[k][3:], rng.integers(0, 2**63, 3, dtype=np.uint64)]))
    begun = time.perf_counter()
    got = dict(joined(list(range(len(sets))), sets, 90))
    assert got == {i: i - 1 if i < 200 and i % 2 else i for i in range(len(sets))}
    assert time.perf_counter() - begun < 60


def test_jaccard_awkward(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in jaccard_components(docs).collect()]
    assert len(got) == len(rows)
    assert {r for r in got if r[0] is not None} == brute_components(rows)
    assert {r[2] for r in got if r[0] is None} == {None}
    assert jaccard_components(empty(spark)).count() == 0


def test_recursive_regions_equal_all_pairs():
    rng = np.random.default_rng(3)
    for trial in range(6):
        sets = []
        for g in range(5):
            base = rng.integers(0, 2**63, 60 + 30 * g, dtype=np.uint64)
            for _ in range(30):
                s = base.copy()
                s[rng.integers(0, len(s), rng.integers(0, 6))] = rng.integers(0, 2**63, 1, dtype=np.uint64)
                sets.append(np.unique(s))
        order = rng.permutation(len(sets))
        sets = [sets[i] for i in order]
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 90 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        assert joined(list(range(len(sets))), sets, 90) == [(i, find(i)) for i in range(len(sets))]
