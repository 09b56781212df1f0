"""Token counts: linear longest-match automaton over a word-piece vocabulary.

The vocabulary is a trie.  Each node has a failure link (the node of the
text left over once the greedy pieces that are already certain are taken off)
and the number of pieces taken off on the way.  A word is read once, left to
right; the count of its greedy longest-match pieces falls out, pieces are
never built.  A word starts with a mark, as pieces that start words do in
the vocabulary; a word that can't be cut into pieces is one unknown token.

Lengths of frequent words are kept per worker, up to a fixed number.

Defined results: null, empty and blank texts have no words and no tokens; null
ids and repeated rows get a row each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, id_and_text, tidy
from .packing import slices_by_size

WORD_START = "▁"
UNKNOWN = 1 << 40            # added to a word's length of 1: sums count unknown words too
KEPT_WORDS, KEPT_LENGTH = 400_000, 64


def vocabulary(model_path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model, in id order."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class PieceAutomaton:
    def __init__(self, pieces: list[str]):
        self.go: list[dict[str, int]] = [{}]
        self.fail: list[int] = [-1]
        self.popped: list[int] = [0]
        ends = set()
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.go[node].get(c)
                if nxt is None:
                    nxt = self.go[node][c] = len(self.go)
                    self.go.append({})
                    self.fail.append(-1)
                    self.popped.append(0)
                node = nxt
            if node:
                ends.add(node)
        queue = [0]
        for node in queue:                                   # breadth first: links lead to shorter texts
            for c, child in self.go[node].items():
                if child in ends:
                    self.fail[child], self.popped[child] = 0, 1
                else:
                    at, taken = self.fail[node], self.popped[node]
                    while at >= 0 and c not in self.go[at]:
                        taken += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.go[at][c], taken
                queue.append(child)

    def length(self, word: str) -> int:
        """Greedy pieces of a word; 1 + UNKNOWN if it can't be cut."""
        go, fail, popped = self.go, self.fail, self.popped
        node = taken = 0
        for c in WORD_START + word:
            nxt = go[node].get(c)
            while nxt is None:
                taken += popped[node]
                node = fail[node]
                if node < 0:
                    return 1 + UNKNOWN
                nxt = go[node].get(c)
            node = nxt
        while node > 0:
            taken += popped[node]
            node = fail[node]
        return taken if node == 0 else 1 + UNKNOWN


class KnownLengths(dict):
    """word -> length; frequent words stay, once full new ones are worked out each time."""

    def __init__(self, automaton: PieceAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.length(word)
        if len(self) < KEPT_WORDS and len(word) <= KEPT_LENGTH:
            self[word] = n
        return n


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def _count(pieces: list[str]):
    key = hash(tuple(pieces))

    def run(batches):
        known = held(("piece lengths", key), lambda: KnownLengths(PieceAutomaton(pieces)))
        get = known.__getitem__
        for whole in batches:
            for batch in slices_by_size(whole, "text"):
                words, tokens, unknown = [], [], []
                for text in batch.column("text").to_pylist():
                    split = (text or "").split()
                    total = sum(map(get, split))
                    words.append(len(split))
                    tokens.append(total % UNKNOWN)
                    unknown.append(total // UNKNOWN)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()),
                                                  pa.array(unknown, pa.int64())], schema=COUNTS)
    return tidy(run)


def count_tokens(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens (an unknown word is one), n_unknown."""
    return id_and_text(docs, id_col, text_col).mapInArrow(
        _count(pieces), "doc_id long, n_words long, n_tokens long, n_unknown long")
