"""Packing: cutting stock by column generation.

1. Documents are tokenised in tasks; a document longer than a sequence is cut
   into full pieces and one rest.  Piece lengths are counted by class (multiples of
   a grain), a histogram of fixed size.
2. The driver solves the cutting-stock linear program over patterns (how many
   pieces of each class share a sequence).  Column generation: an unbounded
   knapsack, by dynamic programming over the sequence length, finds the
   pattern of best price under the current duals.  Floors of the solution,
   plus a best-fit of the few pieces that the floors leave, are whole patterns.
3. Pieces are ranked within their class (hash buckets and bucket offsets, so a
   class of any size is ranked in many tasks); a rank falls into one
   slot of one copy of one pattern.
4. Rounding up to the grain leaves gaps.  A few hash groups of documents are
   held back from step 2, just enough to fill all gaps: their tokens are poured, in
   order, into the gaps and then into further sequences, and cut where a gap
   ends.  The last tokens make sequences of powers of two.

Only the histogram and the patterns, both of fixed size, pass the driver.

Defined results: a null or empty text is a document of the end id alone;
repeated rows are packed as often as they occur; an empty table gives an
empty result; null ids are packed like others; other columns are ignored.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, id_and_text, materialise, parts_for, tidy
from .word_hashes import ByteHasher, text_bytes, word_bounds

GROUPS = 256        # hash groups of documents
HELD_BACK = 16      # groups whose ids are kept, so that they can be cut anywhere
SHORT = 256         # pieces of fewer ids are kept in all groups: rounding costs them the most
COMPARED_TEXTS = 4
CACHED_WORDS = 2_400_000
LATIN_END = "\u0250"         # letters below fold alike in Python and in the tokenizer
ROWS_PER_BUCKET = 5_000


# --- tokens ---------------------------------------------------------------

BLANK, LINE_END = 32, 10


class WordIds:
    """Token ids of texts, found once per blank-separated word.

    White space never joins tokens of this tokenizer, so a text's ids are those of
    its words in turn.  Words are named by a 64-bit hash of their bytes (and
    their length), computed for all words of a batch at once; hashes are kept
    sorted, next to where a word's ids lie in one long array."""

    def __init__(self, tokenizer_path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # for lower-case Latin words, which need no normalising and no pattern to be split at blanks
        self.plain = Tokenizer.from_file(tokenizer_path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(),
                                                            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.compared = 0
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.word_end[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,;:!?"}
        self.marks = {m: ids[0] for m, ids in self.marks.items() if len(ids) == 1}
        self.hasher = ByteHasher()
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.first = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype="<u4")

    def encoded(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word.  Words of letters alone go through the tokenizer as
        one text: each is one token run, whose last id is a word-end id."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha() and w == w.lower() and max(w) < LATIN_END] if self.plain else []
        runs = [plain[at:at + 100] for at in range(0, len(plain), 100)]
        texts = [" ".join([words[i] for i in run]) for run in runs]
        if self.compared < COMPARED_TEXTS:                   # the short way has to agree with the whole tokenizer
            for text in texts[:COMPARED_TEXTS]:
                self.compared += 1
                if self.plain.encode(text, add_special_tokens=False).ids != self.tokenizer.encode(text, add_special_tokens=False).ids:
                    self.plain = None
                    return self.encoded(words)
        for run, enc in zip(runs, self.plain.encode_batch_fast(texts, add_special_tokens=False) if runs else []):
            ids = np.asarray(enc.ids, dtype="<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(run):
                for i, a, b in zip(run, [0, *ends.tolist()], ends.tolist()):
                    out[i] = ids[a:b]
        alone = [i for i, got in enumerate(out) if got is None]
        for i, enc in zip(alone, self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)):
            out[i] = np.asarray(enc.ids, dtype="<u4")
        return out

    def insert(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Add words that aren't known, in any order."""
        order = np.argsort(keys)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.first, self.count = (np.insert(old, at, new[order]) for old, new in (
            (self.keys, keys), (self.first, first), (self.count, count)))

    def names(self, words: list[str]) -> np.ndarray:
        """Hashes of words."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(w) for w in raw], dtype=np.int64)
        ends = np.cumsum(lengths)
        return self.hasher.words(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - lengths, ends)

    def ids_at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in these rows, in turn; where each word's ids end)."""
        count = self.count[rows]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        return self.ids[np.repeat(self.first[rows] - (upto - count), count) + np.arange(total)], upto

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add new words.  Case is folded and letters never join with marks: a word of
        Latin letters, with or without one closing mark, is its lower-case letters' ids and the mark's."""
        marks, low = self.marks, []
        for w in words:
            letters = w[:-1] if w[-1] in marks else w
            folded = letters.lower()                 # must be letters too: a capital I with a dot becomes an i and a mark
            low.append(folded if letters.isalpha() and folded.isalpha() and (letters.isascii() or max(letters) < LATIN_END) else w)
        bare = list(set(low))
        names = self.names(bare)
        new = np.flatnonzero(~self.has(names))
        got = self.encoded([bare[i] for i in new])
        self.insert(names[new], np.array([len(g) for g in got], dtype=np.int64), np.concatenate(got) if got else self.ids[:0])
        built = np.flatnonzero(np.array([a != b for a, b in zip(words, low)], dtype=bool))
        if not len(built):
            return
        ids, upto = self.ids_at(np.searchsorted(self.keys, self.names([low[i] for i in built])))
        mark = np.array([marks.get(words[i][-1], 0) for i in built], dtype="<u4")
        has_mark = np.array([words[i][-1] in marks for i in built], dtype=bool)
        self.insert(keys[built], np.diff(upto, prepend=0) + has_mark, np.insert(ids, upto[has_mark], mark[has_mark]))

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def of(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids end); a null text has none."""
        data, bounds = text_bytes(text)
        starts, ends = word_bounds((data != BLANK) & (data != LINE_END), bounds)
        if not len(starts):
            return np.empty(0, dtype="<u4"), np.zeros(len(bounds) - 1, dtype=np.int64)
        keys, sample, word = np.unique(self.hasher.words(data, starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(~self.has(keys))
        if len(self.keys) + 2 * len(new) > CACHED_WORDS:     # start anew with the words of these texts
            self.clear()
            new = np.arange(len(keys))
        if len(new):
            self.learn(keys[new], [bytes(data[a:b]).decode() for a, b in zip(starts[sample[new]], ends[sample[new]])])
        ids, upto = self.ids_at(np.searchsorted(self.keys, keys)[word])
        nth = np.searchsorted(starts, bounds[1:])            # words before each text's end
        return ids, np.concatenate([[0], upto])[nth]


def slices_by_size(batch: pa.RecordBatch, column: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``chars`` bytes of text each: bounds a task's memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += int(size)
        if total >= chars:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("grp", pa.int32()), ("ids", pa.binary())])


def _tokenise(tokenizer_path: str, end_id: int, size: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from zlib import crc32
        ids_of = held(("word ids", tokenizer_path), lambda: WordIds(tokenizer_path))
        for whole in batches:
            for batch in slices_by_size(whole, "text", 1_500_000):
                rows, begin = [], 0
                ids, upto = ids_of.of(batch.column("text"))
                for doc_id, grp, stop in zip(batch.column("doc_id").to_pylist(), batch.column("grp").to_pylist(), upto.tolist()):
                    own = ids[begin:stop].tobytes() + end
                    begin, tokens = stop, len(own) // 4
                    for at in range(0, tokens, size):
                        piece = own[4 * at:4 * (at + size)]
                        rows.append((doc_id, at, len(piece) // 4, crc32(piece), tokens, grp,
                                     piece if grp < HELD_BACK or len(piece) < 4 * SHORT else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)] if rows
                                                 else [pa.array([], f.type) for f in PIECES], schema=PIECES)
    return tidy(run)


# --- patterns -------------------------------------------------------------

def best_pattern(sizes: np.ndarray, price: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of largest total price within ``width``."""
    best = np.zeros(width + 1)
    last = np.full(width + 1, -1)
    for w in range(1, width + 1):
        best[w] = best[w - 1]
        usable = np.searchsorted(sizes, w, side="right")
        if usable:
            gain = best[w - sizes[:usable]] + price[:usable]
            i = int(gain.argmax())
            if gain[i] > best[w] + 1e-12:
                best[w], last[w] = gain[i], i
    pattern, w = np.zeros(len(sizes), dtype=np.int64), width
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            pattern[last[w]] += 1
            w -= sizes[last[w]]
    return float(best[width]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, width: int, gap: float = 1e-4,
                  rounds: int = 4000) -> list[tuple[int, np.ndarray]]:
    """Whole patterns (copies, pieces of each size) that use up ``demand`` exactly.

    Revised simplex over the patterns found so far; stops when the knapsack's
    best price shows the linear program to be within ``gap`` of its optimum."""
    m = len(sizes)
    if m == 0:
        return []
    patterns = np.diag(width // sizes).astype(np.int64)      # basic patterns, by column
    inverse = np.diag(1.0 / (width // sizes))
    x = inverse @ demand
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        value, column = best_pattern(sizes, dual, width)
        if value <= 1 + gap:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        patterns[:, out] = column
        x = np.maximum(inverse @ demand, 0)
    copies = np.floor(x + 1e-6).astype(np.int64)
    while (over := patterns @ copies - demand).max() > 0:     # a floor that rounding errors pushed up
        row = int(over.argmax())
        copies[int(np.where(copies > 0, patterns[row], 0).argmax())] -= 1
    made = [(int(n), patterns[:, j].copy()) for j, n in enumerate(copies) if n]
    return made + _best_fit(sizes, demand - patterns @ copies, width)


def _best_fit(sizes: np.ndarray, left: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """The pieces that the floors leave (at most one pattern's worth per size),
    largest first, each into the fullest sequence that still has room."""
    room: list[tuple[int, int]] = []
    made: list[np.ndarray] = []
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[i])):
            at = next((k for k, (free, _) in enumerate(room) if free >= sizes[i]), None)
            if at is None:
                made.append(np.zeros(len(sizes), dtype=np.int64))
                free, seq = width, len(made) - 1
            else:
                free, seq = room.pop(at)
            made[seq][i] += 1
            insort(room, (free - int(sizes[i]), seq))
    return [(1, p) for p in made]


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


# --- ranks and running totals ---------------------------------------------

def ranked(df: DataFrame, keys: list[str], order: list, buckets: int, salt: list[str]) -> DataFrame:
    """``rank`` from 0 within ``keys``, found in ``buckets`` tasks per key."""
    b = df.withColumn("bucket", F.pmod(F.xxhash64(*salt), F.lit(buckets)))
    counts = b.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(*keys, "bucket", (F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order)) - 1
    return (b.withColumn("within", within).join(before, [*keys, "bucket"])
            .withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "within", "before"))


def running(df: DataFrame, bucket, order: list, value: str, name: str) -> DataFrame:
    """Total of ``value`` over all rows before, in the order (bucket, order)."""
    b = df.withColumn("bucket", bucket)
    sums = b.groupBy("bucket").agg(F.sum(value).alias("v"))
    before = sums.select("bucket", (F.sum("v").over(Window.orderBy("bucket")) - F.col("v")).alias("before"))
    within = F.sum(value).over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (b.withColumn("within", within - F.col(value)).join(before, "bucket")
            .withColumn(name, F.col("before") + F.col("within")).drop("bucket", "within", "before"))


# --- the operator ---------------------------------------------------------

def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 4096, grain: int = 16,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(GROUPS)).cast("int").alias("grp")    # repeated ids spread too
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp int, ids binary"
    pieces = materialise(id_and_text(docs, id_col, text_col).select("doc_id", "text", salt)
                         .mapInArrow(_tokenise(tokenizer_path, end_id, size), schema)
                         .withColumn("cls", F.ceil(F.col("length") / grain).cast("int"))
                         .withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    width = size // grain
    hist = np.zeros((GROUPS, width + 1), dtype=np.int64)     # pieces by (group, class): fixed size
    tokens = np.zeros((GROUPS, width + 1), dtype=np.int64)
    for r in pieces.groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t")).collect():
        hist[r["grp"], r["cls"]] += r["n"]
        tokens[r["grp"], r["cls"]] += r["t"]
    short = np.arange(width + 1) < SHORT // grain

    def held_back(held: int) -> np.ndarray:
        """(group, class) cells that are poured: all classes of the first groups, then short ones of more."""
        group = np.arange(GROUPS)[:, None]
        return (group < min(held, HELD_BACK)) | (short[None, :] & (group < held))

    def solve(held: int):
        poured = held_back(held)
        demand = np.where(poured, 0, hist).sum(axis=0)
        sizes = np.flatnonzero(demand)
        made = cutting_stock(sizes, demand[sizes], width)
        return sizes, made, sum(n for n, _ in made) * size - int(tokens[~poured].sum())

    kept = np.array([tokens[held_back(h)].sum() for h in range(GROUPS + 1)])
    held = 1
    sizes, made, slack = solve(held)
    while slack > kept[held] and held < GROUPS:
        enough = np.flatnonzero(kept >= slack)
        held = min(GROUPS, max(held + 1, int(enough[0]) if len(enough) else GROUPS))
        sizes, made, slack = solve(held)
    fluid_rows = (F.col("grp") < min(held, HELD_BACK)) | ((F.col("cls") < SHORT // grain) & (F.col("grp") < held))

    # slots: for each class, ranks from first_rank on lie in copies of one pattern
    slots, taken, first_seq = {}, np.zeros(len(sizes), dtype=np.int64), 0
    for copies, pattern in made:
        for i in np.flatnonzero(pattern):
            slots.setdefault(int(sizes[i]), []).append((int(taken[i]), int(pattern[i]), first_seq))
            taken[i] += copies * int(pattern[i])
        first_seq += copies
    slot_rows = spark.createDataFrame([(c, s) for c, s in slots.items()],
                                      "cls int, slots array<struct<first_rank: long, each: int, first_seq: long>>")
    n = int(hist.sum())
    buckets = parts_for(n, ROWS_PER_BUCKET)
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    placed = (ranked(pieces.where(~fluid_rows).drop("ids", "grp"), ["cls"], order, buckets, ["doc_id", "start", "uid"])
              .join(F.broadcast(slot_rows), "cls")           # at most size / grain rows
              .withColumn("slot", F.element_at("slots", F.size(F.filter("slots", lambda s: s["first_rank"] <= F.col("rank")))))
              .withColumn("past", F.col("rank") - F.col("slot.first_rank"))
              .withColumn("sequence_id", F.col("slot.first_seq") + F.floor(F.col("past") / F.col("slot.each"))))
    in_seq = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "past").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = placed.withColumn("offset", F.sum("length").over(in_seq) - F.col("length")).select(*columns)
    poured_tokens = int(kept[held])
    if not poured_tokens:
        return placed
    placed = materialise(placed, "pack-placed")

    # gaps: what patterns leave, then new sequences, the last ones powers of two
    gaps = (placed.groupBy("sequence_id").agg(F.sum("length").alias("base"))
            .withColumn("room", size - F.col("base")).where("room > 0"))
    gaps = running(gaps, F.floor(F.col("sequence_id") / ROWS_PER_BUCKET), ["sequence_id"], "room", "at")
    rest = max(0, poured_tokens - slack)
    tail, at, seq = [], slack + rest // size * size, first_seq + rest // size
    for room in powers_of_two(rest % size):
        tail.append((seq, 0, room, at))
        at, seq = at + room, seq + 1
    more = spark.range(rest // size).select((F.col("id") + first_seq).alias("sequence_id"), F.lit(0).cast("long").alias("base"),
                                            F.lit(size).cast("long").alias("room"), (F.lit(slack) + F.col("id") * size).alias("at"))
    gaps = (gaps.select("sequence_id", "base", F.col("room").cast("long"), "at").unionByName(more)
            .unionByName(spark.createDataFrame(tail, "sequence_id long, base long, room long, at long")))
    fluid = running(pieces.where(fluid_rows).drop("cls", "grp"),
                    F.pmod(F.xxhash64("doc_id", "start", "uid"), F.lit(parts_for(int(hist[held_back(held)].sum()), ROWS_PER_BUCKET))), order, "length", "from")

    def by_block(df: DataFrame, first: str, length: str) -> DataFrame:
        return df.withColumn("block", F.explode(F.sequence(F.floor(F.col(first) / size),
                                                           F.floor((F.col(first) + F.col(length) - 1) / size))))

    lo, hi = F.greatest("from", "at"), F.least(F.col("from") + F.col("length"), F.col("at") + F.col("room"))
    poured = (by_block(fluid, "from", "length").join(by_block(gaps, "at", "room"), "block")
              .withColumn("lo", lo).withColumn("hi", hi)
              .where((F.col("lo") < F.col("hi")) & (F.col("block") == F.floor(F.col("lo") / size)))
              .withColumn("skip", F.col("lo") - F.col("from"))
              .select("doc_id", (F.col("start") + F.col("skip")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"),
                      F.crc32(F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * (hi - lo) as int))")).alias("ids_crc32"),
                      "doc_tokens", "sequence_id", (F.col("base") + F.col("lo") - F.col("at")).alias("offset")))
    return placed.unionByName(poured.select(*columns))


def padding(lengths: list[int], size: int = 4096) -> int:
    """Padding of sequences of these lengths: up to ``size``, none at a power of two."""
    return sum(0 if n & (n - 1) == 0 else size - n for n in lengths if n)
