"""N-gram Jaccard join: an exact join in the metric space of shingle sets.

Jaccard distance is a metric; two documents link when theirs is at most
``r`` = 1 - threshold.  The join goes from wide regions to narrow ones.

1. Pivots that are single shingles.  A set is equally near to every shingle it
   holds and at distance 1 from all others; one global order of shingles (frequent
   ones last, then by hash) breaks the ties.  A linked partner lacks at most
   n - ceil(threshold * n) of a set's n shingles, so replicating a set to the
   regions of its first n - ceil(threshold * n) + 1 pivots makes
   every linked pair meet in the region of its first common pivot.
2. A set stays in a region if the region holds a set of a size to link with.
   Inside, distances to fixed pivots (the empty set: the set's size; the hash
   classes of shingles: counts per class) bound the distance of two sets by the
   triangle inequality.  Pairs within all bounds join their sets into one
   candidate region; a spanning forest is kept, not the pairs.  A region of more than ``pivot_rows`` sets is cut
   into blocks by hash, and every two blocks meet in a task of their own.
3. Each candidate region gets its whole sets.  Documents are chosen as pivots and
   compared with all; a document's home is its nearest pivot, and it is replicated to every pivot
   within 2r of that distance, as two linked documents have distances to any
   pivot that differ by at most r.  Regions join recursively; a region that no
   longer shrinks is finished by comparing pivots outside its largest component with the documents that
   share one of the rarest shingles (in the region) that a link can't do without, skipping
   those that the distances to earlier pivots rule out.
4. A candidate region beyond ``most_shingles`` is first compared with a few of
   its own documents in many tasks.  Documents linked to their largest component need no
   comparison with each other; the rest meets every block of the region, block by block.

Identical sets are one class throughout, so copies are never paired.

Shingles are named by 64-bit hashes of their words.  Defined results: a null text, an empty one or one
without words has no shingles and is its own component; fewer words than a shingle has
are one shingle; a null id has a null component and links with nothing;
repeated rows of an id with different texts are one node; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialise, tidy
from .components import connected_components
from .packing import slices_by_size
from .word_hashes import ByteHasher, mix, text_bytes, word_bounds

HEAVY_SHARE = 1000            # a shingle of more than one document in so many comes last in the order
MOST_SHINGLES = 4_000_000     # of a region that one task joins
SHINGLES_PER_RUN = 2_000_000  # counted together when frequent ones are looked for
BROADCAST_NODES = 1_000_000
PIVOTS = 8
PIVOT_ROWS = 20_000           # of a pivot's region that meet in one task


# --- shingle sets ---------------------------------------------------------

def shingle_sets(text: pa.Array, hasher: ByteHasher, size: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingles of ``size`` words (64-bit) of each text, A-Z lower-cased;
    words are runs of bytes other than blank and control white space."""
    data, bounds = text_bytes(text)
    upper = (data >= 65) & (data <= 90)
    data = data + upper.astype(np.uint8) * np.uint8(32)
    starts, ends = word_bounds((data != 32) & ((data < 9) | (data > 13)), bounds)
    words = hasher.words(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    first = np.searchsorted(starts, bounds)
    one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    places = max(0, len(words) - size + 1)
    grams = words[:places].copy()
    for k in range(1, size):
        grams = mix(grams * (one if k == 1 else two) + words[k:places + k])
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(grams[a:b - size + 1]))
        elif b > a:                                          # fewer words: one shingle that no whole one equals
            short = np.full(1, b - a, dtype=np.uint64)
            for w in words[a:b]:
                short = mix(short * two + one + w)
            sets.append(short)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _heavy_counts(size: int):
    """(shingle, documents) of shingles frequent in a run of documents.  A shingle frequent in the
    whole table is so in some run; the order only has to be one order, so missing one costs time, not results."""
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def counted(held):
        shingle, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= max(3, len(held) // HEAVY_SHARE)
        return pa.RecordBatch.from_arrays([pa.array(shingle[often].view(np.int64)), pa.array(n[often])], schema=schema)

    def run(batches):
        hasher, held, total = ByteHasher(), [], 0
        for whole in batches:
            for batch in slices_by_size(whole, "text"):
                for s in shingle_sets(batch.column("text"), hasher, size):
                    if len(s):
                        held.append(s)
                        total += len(s)
                if total >= SHINGLES_PER_RUN:
                    yield counted(held)
                    held, total = [], 0
        if held:
            yield counted(held)
    return tidy(run)


def heavy_shingles(texts: DataFrame, documents: int, size: int) -> np.ndarray:
    """Shingles of more than one document in HEAVY_SHARE; at most the average set size times HEAVY_SHARE of them."""
    found = (texts.mapInArrow(_heavy_counts(size), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
             .where(F.col("n") > max(10, documents // HEAVY_SHARE)).select("shingle").toPandas())
    return np.sort(found["shingle"].to_numpy(dtype=np.int64).view(np.uint64))


def sketch_width(n: int) -> int:
    """Hash classes of a set of n shingles: about 8 to 16 shingles in each, 32 classes at least."""
    return max(32, 1 << (max(1, n // 8).bit_length() - 1))


def _described(heavy, numerator: int, size: int):
    """(doc_id, n, print, pivots, sketch): fingerprint of the set, its first pivots, its counts by hash class."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()),
                        ("pivots", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches):
        hasher, last = ByteHasher(), heavy.value
        for whole in batches:
            for batch in slices_by_size(whole, "text"):
                prints, pivots, sketches, sizes = [], [], [], []
                for s in shingle_sets(batch.column("text"), hasher, size):
                    n = len(s)
                    sizes.append(n)
                    if not n:
                        prints.append(None)
                        pivots.append([])
                        sketches.append(None)
                        continue
                    prints.append(blake2b(s.tobytes(), digest_size=16).digest())
                    first = n - -(-numerator * n // 100) + 1
                    if len(last):
                        often = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        s = np.concatenate([s[~often], s[often]])
                    pivots.append(s[:first].view(np.int64))
                    classes = (s & np.uint64(sketch_width(n) - 1)).astype(np.int64)
                    sketches.append(np.minimum(np.bincount(classes, minlength=sketch_width(n)), 255).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                                                  pa.array(pivots, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=schema)
    return tidy(run)


# --- step 2: candidate regions --------------------------------------------

class Forest:
    """Union-find over 0..n-1, with labels for numpy."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        p = self.parent
        while True:
            up = p[p]
            if (up == p).all():
                self.parent = p
                return p
            p = up


def whole_groups(batches, key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or more that hold whole runs of ``key``; input sorted by it."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        total += batch.num_rows
        if total >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            if last:
                yield table.slice(0, last)
                held = table.slice(last).to_batches()
                total = table.num_rows - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lowest_widths(sketches: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(width per row, counts by width, row -> line in counts).  Counts of a width also hold rows of twice the width, folded."""
    widths = np.array([len(s) for s in sketches])
    lines, counts = {}, {}
    for w in np.unique(widths):
        own, double = np.flatnonzero(widths == w), np.flatnonzero(widths == 2 * w)
        plain = np.frombuffer(b"".join(sketches[i] for i in own), np.uint8).reshape(-1, w).astype(np.int16)
        folded = np.frombuffer(b"".join(sketches[i] for i in double), np.uint8).reshape(-1, 2, w).astype(np.int16).sum(axis=1)
        counts[w] = np.concatenate([plain, folded.astype(np.int16)])
        lines[w] = np.full(len(sketches), -1)
        lines[w][own] = np.arange(len(own))
        lines[w][double] = len(own) + np.arange(len(double))
    return widths, counts, lines


def candidate_edges(table: pa.Table, numerator: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that meet in a region (column pivot, sorted,
    then by n) within all bounds on their distance."""
    pivot, n, pos = (table.column(c).to_numpy() for c in ("pivot", "n", "pos"))
    ids, node = np.unique(table.column("rep").to_numpy(), return_inverse=True)
    widths, counts, lines = _lowest_widths(table.column("sketch").to_pylist())
    forest, edges = Forest(len(ids)), []
    label = forest.labels()
    rows = np.arange(len(pivot))
    step, most = 0, 100 - numerator
    while True:
        step += 1
        rows = rows[rows + step < len(pivot)]
        other = rows + step
        rows = rows[(pivot[other] == pivot[rows]) & (numerator * n[other] <= 100 * n[rows])]
        if not len(rows):
            return edges
        a, b = rows, rows + step
        # |symmetric difference| <= most / 100 of the union <= most / (100 + numerator) of both sizes
        room = most * (n[a] + n[b])
        keep = (label[node[a]] != label[node[b]]) & ((100 + numerator) * (pos[a] + pos[b]) <= room)
        a, b, room = a[keep], b[keep], room[keep]
        if not len(a):
            continue
        near = np.zeros(len(a), dtype=bool)
        shared = np.minimum(widths[a], widths[b])
        for w in np.unique(shared):
            for at in range(0, len(a), 100_000):
                use = at + np.flatnonzero(shared[at:at + 100_000] == w)
                far = np.abs(counts[w][lines[w][a[use]]] - counts[w][lines[w][b[use]]]).sum(axis=1, dtype=np.int64)
                near[use] = (100 + numerator) * far <= room[use]
        for x, y in zip(node[a[near]].tolist(), node[b[near]].tolist()):
            if forest.join(x, y):
                edges.append((int(ids[x]), int(ids[y])))
        if near.any():
            label = forest.labels()


def _candidates(numerator: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for table in whole_groups(batches, "pivot"):
            edges = candidate_edges(table, numerator)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], schema=schema)
    return tidy(run)


# --- step 3: recursive join of whole sets ---------------------------------

class Region:
    """Whole sets of a candidate region; links join documents in ``forest``."""

    def __init__(self, sets: list[np.ndarray], numerator: int):
        self.sets, self.numerator = sets, numerator
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.start = np.cumsum(self.size) - self.size
        self.forest = Forest(len(sets))

    def distances(self, pivot: int, docs: np.ndarray) -> np.ndarray:
        """Jaccard distances of ``docs`` to a pivot; linked ones are joined."""
        mine, size = self.sets[pivot], self.size[docs]
        start = np.cumsum(size) - size
        flat = self.flat if len(docs) == len(self.sets) else self.flat[
            np.repeat(self.start[docs] - start, size) + np.arange(int(size.sum()))]
        same = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        common = np.add.reduceat(same, start, dtype=np.int64)
        union = size + len(mine) - common
        for d in docs[100 * common >= self.numerator * union].tolist():
            self.forest.join(pivot, d)
        return 1 - common / union

    def join(self, docs: np.ndarray) -> None:
        """Join ``docs`` exactly: recursive Voronoi regions, then the rest pivot by pivot."""
        r = 1 - self.numerator / 100 + 1e-9
        todo = [docs]
        while todo:
            docs = todo.pop()
            label = self.forest.labels()[docs]
            if len(docs) < 2 or (label == label[0]).all():
                continue
            values, of, n = np.unique(label, return_inverse=True, return_counts=True)
            outside = np.flatnonzero(of != n.argmax())
            pivots = outside[np.linspace(0, len(outside) - 1, min(PIVOTS, len(outside))).astype(int)] if len(docs) > 4 * PIVOTS else outside
            pivots = np.unique(pivots)
            far = np.stack([self.distances(int(docs[p]), docs) for p in pivots])
            if len(pivots) == len(outside):
                continue                                     # every document outside the largest component was compared with all
            home = far.min(axis=0)
            parts = [np.flatnonzero(row <= home + 2 * r) for row in far]
            parts = [p for p in parts if len(p)]
            if max(map(len, parts)) <= 0.7 * len(docs) and sum(map(len, parts)) <= 2 * len(docs):
                todo += [docs[p] for p in parts]
            else:
                self.rest(docs, far, pivots, r)

    def rest(self, docs: np.ndarray, far: np.ndarray, done: np.ndarray, r: float) -> None:
        """A region that doesn't shrink: compare documents outside the largest component, one by one, with
        those that share a shingle of both prefixes: ordered by their number in the region, linked sets
        share one of their first n - ceil(threshold * n) + 1.  Of sets whose first common shingle comes late, what
        follows it is too short for a link."""
        compared = np.zeros(len(docs), dtype=bool)
        compared[done] = True
        token, of_doc, follow = self.prefixes(docs)
        by_token = np.argsort(token, kind="stable")
        listed, lists, rest_of = token[by_token], of_doc[by_token], follow[by_token]
        starts = np.searchsorted(of_doc, np.arange(len(docs) + 1))
        while True:
            label = self.forest.labels()[docs]
            values, of, n = np.unique(label, return_inverse=True, return_counts=True)
            left = np.flatnonzero((of != n.argmax()) & ~compared)
            if not len(left):
                return
            p = int(left[0])
            compared[p] = True
            mine = token[starts[p]:starts[p + 1]]
            low, high = np.searchsorted(listed, mine), np.searchsorted(listed, mine, side="right")
            met = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(int((high - low).sum()))
            near, first = np.unique(lists[met], return_index=True)
            most = np.minimum(rest_of[met[first]], np.repeat(follow[starts[p]:starts[p + 1]], high - low)[first])     # common shingles at most
            size = self.size[docs[near]]
            near = near[(label[near] != label[p]) & ((100 + self.numerator) * most >= self.numerator * (size + self.size[docs[p]]))]
            near = near[(np.abs(far[:, near] - far[:, p:p + 1]) <= r).all(axis=0)]
            if len(near):
                self.distances(int(docs[p]), docs[near])

    def prefixes(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, place in ``docs``, shingles from it on) of every document's prefix: its rarest shingles within ``docs``."""
        size = self.size[docs]
        of = np.repeat(np.arange(len(docs)), size)
        begin = np.cumsum(size) - size
        _, token, n = np.unique(self.flat[np.repeat(self.start[docs] - begin, size) + np.arange(int(size.sum()))], return_inverse=True, return_counts=True)
        order = np.lexsort((token, n[token], of))
        first = size - -(-self.numerator * size // 100) + 1
        at = np.arange(len(of)) - np.repeat(begin, size)
        used = at < np.repeat(first, size)
        return token[order][used], of[used], (np.repeat(size, size) - at)[used]


def joined(ids: list[int], sets: list[np.ndarray], numerator: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """(id, smallest id of its component) of documents of one region; ``known``: label of components already found, -1 for none."""
    region = Region(sets, numerator)
    if known is not None:
        first: dict[int, int] = {}
        for i, k in enumerate(known):
            if k >= 0:
                region.forest.join(first.setdefault(k, i), i)
    order = {}
    for i, d in enumerate(ids):                              # rows of one id are one node
        region.forest.join(order.setdefault(d, i), i)
    region.join(np.arange(len(ids)))
    label = region.forest.labels()
    least: dict[int, int] = {}
    for i, d in zip(label.tolist(), ids):
        least[i] = min(d, least.get(i, d))
    return [(d, least[i]) for i, d in zip(label.tolist(), ids)]


def _sets_of(size: int):
    schema = pa.schema([("region", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        hasher = ByteHasher()
        for whole in batches:
            for batch in slices_by_size(whole, "text"):
                sets = shingle_sets(batch.column("text"), hasher, size)
                yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("rep"), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)
    return tidy(run)


def _join_regions(numerator: int, key: str):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for table in whole_groups(batches, key, rows=2_000):
            keys = table.column(key).to_numpy()
            reps, raw = table.column("rep").to_pylist(), table.column("shingles").to_pylist()
            known = table.column("known").to_pylist() if "known" in table.column_names else None
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    out += joined(reps[a:b], [np.frombuffer(x, np.uint64) for x in raw[a:b]], numerator, known and known[a:b])
            out = [(x, y) for x, y in out if x != y]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], schema=schema)
    return tidy(run)


# --- step 4: regions beyond one task --------------------------------------

def _pivot_links(numerator: int):
    def run(frames):
        for f in frames:
            common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                      for x, y in zip(f["shingles"], f["pivot_shingles"])]
            union = f["n"] + f["pivot_n"] - common
            f["linked"] = 100 * np.array(common, dtype=np.int64) >= numerator * union
            yield f[f["linked"]][["region", "rep", "pivot"]]
    return tidy(run)


def _largest(f: pd.DataFrame) -> pd.DataFrame:
    """Of one region's link masks (bits: pivots linked) and their counts, the pivots of the largest component."""
    forest = Forest(64)
    for mask in f["mask"]:
        bits = [i for i in range(64) if int(mask) >> i & 1]
        for b in bits[1:]:
            forest.join(bits[0], b)
    size: dict[int, int] = {}
    for mask, n in zip(f["mask"], f["n"]):
        root = forest.find((int(mask) & -int(mask)).bit_length() - 1)
        size[root] = size.get(root, 0) + int(n)
    root = max(size, key=lambda k: (size[k], -k))
    return pd.DataFrame({"region": [f["region"].iloc[0]], "mask": [sum(1 << i for i in range(PIVOTS) if forest.find(i) == root)]})


def large_region_edges(sets: DataFrame, numerator: int, most_shingles: int) -> DataFrame:
    """Links (a, b) of regions of any size; ``sets``: region, rep, n, shingles."""
    blocks_of = sets.groupBy("region").agg(F.sum("n").alias("total")).select(
        "region", F.ceil(2 * F.col("total") / most_shingles).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = materialise(sets.join(blocks_of, "region").withColumn("block", block), "jaccard-large")
    chosen = (rows.groupBy("region").agg(F.slice(F.sort_array(F.collect_set(
        F.when(F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest(F.col("blocks"), F.lit(1))) == 0, F.col("rep")))), 1, PIVOTS).alias("p"))
        .select("region", F.posexplode("p").alias("bit", "rep")))
    pivots = (rows.join(chosen, ["region", "rep"])
              .select("region", "bit", F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"), F.col("shingles").alias("pivot_shingles"),
                      F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    links = materialise(rows.join(pivots.drop("bit"), ["region", "block"])
                        .select("region", "rep", "n", "shingles", "pivot", "pivot_n", "pivot_shingles")
                        .mapInPandas(_pivot_links(numerator), "region long, rep long, pivot long"), "jaccard-pivot-links")
    masks = (links.join(chosen.select("region", F.col("rep").alias("pivot"), "bit").distinct(), ["region", "pivot"])
             .groupBy("region", "rep").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))
    largest = (masks.groupBy("region", "mask").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("region").applyInPandas(_largest, "region long, mask long"))
    settled = masks.join(largest.withColumnRenamed("mask", "best"), "region").where("mask & best <> 0").select("region", "rep", F.lit(0).alias("known"))
    marked = materialise(rows.join(settled, ["region", "rep"], "left").withColumn("known", F.coalesce("known", F.lit(-1))), "jaccard-marked")
    # documents outside the largest component, in blocks of their own, meet every block of their region
    open_blocks = (marked.where("known < 0").groupBy("region").agg(F.sum("n").alias("open"))
                   .select("region", F.ceil(2 * F.col("open") / most_shingles).cast("int").alias("open_blocks")))
    shared = marked.join(open_blocks, "region")
    own = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("open_blocks")).cast("int")
    asking = (shared.where("known < 0").withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    asked = shared.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("open_blocks") - 1))).withColumn("j", F.col("block"))
    met = (asking.select("region", "i", "j", "rep", "shingles", "known").unionByName(asked.select("region", "i", "j", "rep", "shingles", "known"))
           .withColumn("task", F.xxhash64("region", "i", "j")))
    tested = (met.select("task", "rep", "shingles", "known").repartition("task").sortWithinPartitions("task", "rep")
              .mapInArrow(_join_regions(numerator, "task"), "a long, b long"))
    return links.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).unionByName(tested)


# --- the operator ---------------------------------------------------------

def jaccard_components(docs: DataFrame, threshold_percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
                       most_shingles: int = MOST_SHINGLES, shingle_words: int = 3, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.  Shingles have ``shingle_words`` words."""
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    heavy = spark.sparkContext.broadcast(heavy_shingles(texts.select("text"), texts.count(), shingle_words))     # bounded, see heavy_shingles
    described = materialise(texts.mapInArrow(_described(heavy, threshold_percent, shingle_words),
                                             "doc_id long, n long, print binary, pivots array<long>, sketch binary"), "jaccard-sets")
    classes = materialise(described.where("doc_id is not null and n > 0").groupBy("print")
                          .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("pivots").alias("pivots"),
                               F.first("sketch").alias("sketch")), "jaccard-classes")
    # in order of size, a set's nearest neighbours tell whether any set of its region is of a size to link with
    by_size = Window.partitionBy("pivot").orderBy("n")
    met = (classes.select("rep", "n", F.posexplode("pivots").alias("pos", "pivot"))
           .withColumn("near", (100 * F.lag("n").over(by_size) >= threshold_percent * F.col("n"))
                       | (100 * F.col("n") >= threshold_percent * F.lead("n").over(by_size)))
           .where("near").drop("near"))
    sketches = classes.select("rep", "n", "sketch")          # (rep, n) is a class, but for ids with several texts: more candidates then
    hot = materialise(met.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(pivot_rows)).cast("int").alias("blocks"))
                      .where("blocks > 1"), "jaccard-hot-pivots")
    if not hot.isEmpty():
        met = materialise(met, "jaccard-met").join(hot, "pivot", "left").withColumn("block", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
        met = (met.select("pivot", "rep", "n", "pos", "block", "blocks", other)
               .select(F.when(F.col("blocks").isNull(), F.col("pivot"))
                       .otherwise(F.xxhash64("pivot", F.least("block", "other"), F.greatest("block", "other"))).alias("pivot"), "rep", "n", "pos"))
    pairs = materialise(met.join(sketches, ["rep", "n"]).select("pivot", "rep", "n", F.col("pos").cast("long").alias("pos"), "sketch")
                        .repartition("pivot").sortWithinPartitions("pivot", "n", "rep")
                        .mapInArrow(_candidates(threshold_percent), "a long, b long"), "jaccard-candidates")
    regions = connected_components(pairs).select(F.col("node").alias("rep"), F.col("component").alias("region"))
    if regions.count() <= BROADCAST_NODES:
        regions = F.broadcast(regions)
    sets = materialise(texts.join(regions, F.col("doc_id") == F.col("rep")).select("region", "rep", "text")
                       .mapInArrow(_sets_of(shingle_words), "region long, rep long, n long, shingles binary"), "jaccard-regions")
    large = materialise(sets.groupBy("region").agg(F.sum("n").alias("n")).where(F.col("n") > most_shingles).select("region"), "jaccard-large-ids")
    links = (sets.join(large, "region", "left_anti").repartition("region").sortWithinPartitions("region", "rep")
             .mapInArrow(_join_regions(threshold_percent, "region"), "a long, b long"))
    if large.isEmpty():
        found = links.select(F.col("a").alias("rep"), F.col("b").alias("component"))
    else:
        found = connected_components(links.unionByName(large_region_edges(sets.join(large, "region", "left_semi"), threshold_percent, most_shingles)))
        found = found.select(F.col("node").alias("rep"), "component")
    found = materialise(found, "jaccard-components")
    named = materialise(classes.select("print", "rep").join(found, "rep", "left")
                        .select("print", F.coalesce("component", "rep").alias("component_id")), "jaccard-named")
    return (described.select("doc_id", "n", "print").join(named, "print", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
