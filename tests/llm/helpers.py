"""Awkward inputs and brute-force versions that the operator tests share."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              "hash string, words string, label int, score double, pivot long, rep string, bucket int, part int")


def awkward(spark, rows=None):
    """Documents with nulls in any column, empty and very long texts, repeated
    rows, and extra columns whose names operators use themselves."""
    rng = random.Random(5)
    vocabulary = ["wo" + "".join(rng.choice("aeioult") for _ in range(5)) for _ in range(400)]
    long_text = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    rows = rows if rows is not None else [
        (1, None), (2, ""), (3, " \n\t "), (4, "."), (5, "one"), (6, "one two"), (7, "Alpha beta gamma delta"),
        (8, "alpha BETA gamma delta"), (8, "alpha BETA gamma delta"), (None, "alpha beta gamma delta"), (None, None),
        (9, long_text), (10, long_text + " tail"), (11, "x" * 50_000), (12, "é" * 10 + " ü! <|endoftext|> ` a`b \u1fef \x1c 数据"),
    ]
    return spark.createDataFrame([(i, t, None, "s", None, "h", "w", None, 0.5, 3, "r", 1, 2) for i, t in rows], DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def shingles(text, size=3):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= size:
        return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, percent=90, size=3):
    """doc_id -> (set size, smallest reachable doc_id), by an inverted index over all shingles."""
    sets = [(d, shingles(t, size)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = collections.defaultdict(list)
    for k, (d, s) in enumerate(sets):
        common = collections.Counter(j for g in s for j in seen[g])
        for j, n in common.items():
            e, t = sets[j]
            if 100 * n >= percent * (len(s) + len(t) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
        for g in s:
            seen[g].append(k)
    return {(d, len(s), find(d)) for d, s in sets}


def near_copies(seed=1, groups=6, copies=25, words=120, edits=3):
    """(doc_id, text) rows: groups of near copies of random texts, plus unrelated ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, doc = [], 0
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words + 40 * g)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((doc, " ".join(text)))
            doc += 1
    for _ in range(40):
        rows.append((doc, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 200)))))
        doc += 1
    rng.shuffle(rows)
    return rows
