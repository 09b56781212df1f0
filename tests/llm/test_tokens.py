import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidecast.llm.packing import WordIds, best_pattern, cutting_stock, pack, padding, powers_of_two
from tidecast.llm.wordpiece_counts import UNKNOWN, WORD_START, PieceAutomaton, count_tokens, vocabulary

from .helpers import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_packing(docs, got, size=4096):
    """Every id of every document in exactly one piece; offsets without gaps; returns the sequence lengths."""
    encode = Tokenizer.from_file(PATH).encode
    want = sorted((d is None, d or 0, encode(t or "", add_special_tokens=False).ids + [2]) for d, t in docs)
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for null, d, ids in want:
        own = pieces[None if null else d, len(ids)]
        at, data = 0, np.array(ids, dtype="<u4")
        while at < len(ids):                                  # repeated documents share their pieces' key
            piece = next(r for r in own if r["start"] == at and r["ids_crc32"] == zlib.crc32(data[at:at + r["length"]].tobytes()))
            own.remove(piece)
            assert piece["length"] > 0
            at += piece["length"]
        assert at == len(ids)
    assert not any(pieces.values())
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    lengths = []
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
        lengths.append(at)
    return lengths


def test_packing_awkward(spark):
    docs = awkward(spark)
    lengths = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], pack(docs, PATH).collect())
    assert sum(lengths) > 100_000
    assert pack(empty(spark), PATH).count() == 0


def test_packing_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lengths = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], pack(docs, PATH).collect())
    assert padding(lengths) <= 0.02 * sum(lengths)


@pytest.mark.parametrize("least, most", [(6, 20), (10, 40), (20, 60)])
def test_packing_short_documents(spark, least, most):
    """Rounding up to a class of lengths would leave short documents much padding."""
    rng = random.Random(least)
    rows = [(i, " ".join(rng.choice(("word", "more", "text", "some")) for _ in range(rng.randrange(least, most)))) for i in range(8_000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    lengths = check_packing(rows, got)
    assert padding(lengths) <= 0.02 * sum(lengths)


def test_packing_one_id(spark):
    """A third of the rows share an id and a text, others have none."""
    rows = [(7, "the same few words")] * 900 + [(None, f"text {i}") for i in range(900)] + [(i, "a b c " * (i % 50)) for i in range(900)]
    check_packing(rows, pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect())


def test_word_ids_equal_the_tokenizer():
    """Words of any letters, cases and closing marks, also those whose lower case is no letter."""
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    marks = ["", ".", ",", "!", "?", ":", ";", "'", ")", "..."]
    texts = ["TAR\u0130H\u0130. GEM\u0130, deniz \u0130. \u0130\u0130!"] + [
        " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) + rng.choice(marks) for _ in range(12)) for _ in range(800)]
    texts += [c + m for c in letters for m in marks]
    encode = Tokenizer.from_file(PATH).encode
    ids, upto = WordIds(PATH).of(pa.array(texts))
    at = 0
    for text, end in zip(texts, upto.tolist()):
        assert ids[at:end].tolist() == encode(text, add_special_tokens=False).ids, text
        at = end


def test_cutting_stock_uses_demand_up():
    rng = np.random.default_rng(1)
    sizes = np.unique(rng.integers(1, 100, 60))
    demand = rng.integers(1, 400, len(sizes))
    made = cutting_stock(sizes, demand, 256)
    assert (sum(n * p for n, p in made) == demand).all()
    assert all(p @ sizes <= 256 for _, p in made)
    assert sum(n for n, _ in made) <= 1.01 * (demand @ sizes) / 256 + 3
    assert cutting_stock(sizes[:0], demand[:0], 256) == []


def test_best_pattern_equals_search():
    rng = random.Random(3)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 15), 4)))
        price = np.array([rng.random() for _ in sizes])
        best = [0.0] * 25
        for w in range(1, 25):
            best[w] = max([best[w - 1]] + [best[w - s] + p for s, p in zip(sizes, price) if s <= w])
        value, pattern = best_pattern(sizes, price, 24)
        assert value == pytest.approx(best[24]) and pattern @ price == pytest.approx(value) and pattern @ sizes <= 24


def test_powers_of_two():
    assert powers_of_two(0) == [] and powers_of_two(13) == [8, 4, 1]


def brute_pieces(word, pieces):
    text, at, n = WORD_START + word, 0, 0
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in pieces), None)
        if end is None:
            return 1 + UNKNOWN
        at, n = end, n + 1
    return n


def test_automaton_equals_longest_match():
    rng = random.Random(9)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(12)}
        pieces |= {WORD_START + p for p in list(pieces)[:5]} | ({WORD_START} if rng.random() < 0.5 else set())
        automaton = PieceAutomaton(sorted(pieces))
        for _ in range(200):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randrange(1, 14)))
            assert automaton.length(word) == brute_pieces(word, pieces), (word, pieces)


def test_token_counts(spark):
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    known = set(pieces)
    docs = awkward(spark)
    want = []
    for r in docs.collect():
        n = [brute_pieces(w[:400], known) for w in (r["text"] or "").split()] if r["doc_id"] != 11 else None
        if n is not None:
            want.append((r["doc_id"], len(n), sum(x % UNKNOWN for x in n), sum(x // UNKNOWN for x in n)))
    got = [tuple(r) for r in count_tokens(docs, pieces).collect()]
    assert sorted((g for g in got if g[0] != 11), key=repr) == sorted(want, key=repr)
    assert [g[1] for g in got if g[0] == 11] == [1]
    assert count_tokens(empty(spark), pieces).count() == 0
