"""Conversation prefix trie: count-min screening of prefix digests, exact grouping of the rest.

A node is a distinct sequence of first turns; its members are the conversations that start with it.

1. Turns become (conversation, place, digest, bytes): texts are read once and never shuffled.  Places
   are found by a range-partitioned sort and one carried total per partition, so that one long conversation
   is spread over many tasks.
2. The digest of a prefix is a running sum of hashes of (place, turn), carried over partitions alike.
3. Prefix digests are counted in a count-min sketch of two rows of cells.  Only whether a cell was met more
   than once matters, so cells become bits; tasks send the cells they met (2 bytes each), never whole sketches.
   The finished bits are broadcast: ``most_cells`` bounds them.  An estimate of one proves a prefix to
   have one member: its row of the result is made on the spot.  More prefixes than the cells can
   tell apart only mean more rows in step 4, never other results.
4. Prefixes that may be shared are grouped exactly by digest: partial aggregates first, so that a
   hot prefix leaves a task as one row.
5. Sums over subtrees need no walk over levels.  Every node has one representative, its smallest member; what
   the node adds stands in the representative's row.  A running sum from each conversation's end to its start,
   grouped by node, is the subtree's sum.  Leaves are counted alike.
6. The list of conversations that end in a node is digested as a stream: range-partitioned and joined into
   chunks of ids in many tasks, then only the chunks meet, in order.

Digests are 120 bits of a turn, 124 of a prefix.  Defined results: a null role or text counts as empty; a null turn comes
first; rows of one turn number are ordered by their digest; repeated rows are turns like any other; rows with a
null conversation belong to none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

MASK = (1 << 62) - 1
MOST_CELLS = 1 << 27          # of one row of the sketch, a power of two; two rows as bits are 32 MB
SLICE = 1 << 16
CELLS_PER_RUN = 4_000_000
IDS_PER_CHUNK = 1_000
KEY = ["depth", "p1", "p2"]


# --- running sums over keys of any size -----------------------------------

def _local(key: str, sums: list[str]):
    """Adds part, row (in the partition), last, place and totals (of the key, in the partition) to sorted rows."""
    def run(batches):
        part, rows = TaskContext.get().partitionId(), 0
        last_key, place, totals, waiting = None, 0, [np.uint64(0)] * len(sums), None
        names = ["part", "row", "place", *(f"{s}_total" for s in sums), "last"]

        def told(columns, header, keys, next_key):
            last = np.append(keys[1:] != keys[:-1], keys[-1] != next_key)
            return pa.RecordBatch.from_arrays([*columns, pa.array(last)], names=[*header, *names])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy()
            if waiting is not None:
                yield told(*waiting, keys[0])
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            of = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
            same = (of == 0) & (keys[0] == last_key)
            places = np.arange(n) - start[of] + 1 + np.where(same, place, 0)
            out = []
            for i, name in enumerate(sums):
                value = batch.column(name).to_numpy().astype(np.uint64)
                total = np.cumsum(value, dtype=np.uint64)
                out.append(total - (total[start] - value[start])[of] + np.where(same, totals[i], np.uint64(0)))
            last_key, place, totals = keys[-1], int(places[-1]), [t[-1] for t in out]
            columns = [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(places),
                       *(pa.array((t & np.uint64(MASK)).astype(np.int64)) for t in out)]
            rows += n
            waiting = (columns, batch.schema.names, keys)
        if waiting is not None:
            yield told(*waiting, None)
    return tidy(run)


def running(rows: DataFrame, key: str, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` and, for each: place (from 1, in its key by ``order``), last (of its key) and ``<sum>_total``, the
    running sums modulo 2^62.  Rows are range-partitioned by key and order, so that no key is one task;
    one row per partition passes the driver."""
    totals = [f"{s}_total" for s in sums]
    spread = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = fields + ", part int, row long, place long" + "".join(f", {n} long" for n in totals) + ", last boolean"
    placed = materialise(spread.mapInArrow(_local(key, sums), schema), "trie-running")
    ends = (placed.groupBy("part").agg(F.min_by(key, "row").alias("first"), F.max("row").alias("row"),
                                       F.max_by(F.struct(F.col(key).alias("key"), "place", *totals), "row").alias("end"))
            .orderBy("part").collect())
    carries, key_before, before = [], None, [0] * (1 + len(totals))
    for i, e in enumerate(ends):
        carried = before if key_before == e["first"] else [0] * (1 + len(totals))
        closes = i + 1 == len(ends) or ends[i + 1]["first"] != e["end"]["key"]
        carries.append((e["part"], e["first"], e["row"], closes, *carried))
        own = [e["end"][c] for c in ("place", *totals)]
        before = [(a + b) & MASK for a, b in zip(own, carried)] if e["end"]["key"] == e["first"] else own
        key_before = e["end"]["key"]
    carry = rows.sparkSession.createDataFrame(carries, "part int, c_key long, c_row long, c_closes boolean, c_place long"
                                              + "".join(f", c_{n} long" for n in totals))
    def carried_on(n):
        return F.when(F.col(key) == F.col("c_key"), (F.col(n) + F.col(f"c_{n}")).bitwiseAND(F.lit(MASK))).otherwise(F.col(n)).alias(n)

    return (placed.join(F.broadcast(carry), "part")
            .select(*rows.columns, *map(carried_on, ("place", *totals)),
                    F.when(F.col("row") == F.col("c_row"), F.col("c_closes")).otherwise(F.col("last")).alias("last")))


# --- turns ------------------------------------------------------------------

def turn_digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, place from 1, h1, h2, n_bytes, last) of every turn, in order of turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = (conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                                  digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
             .where("conv_id is not null")
             .select("conv_id", "turn", *[F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(h) for h, at in (("h1", 1), ("h2", 16))],
                     "n_bytes", F.monotonically_increasing_id().alias("tie")))
    placed = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("tie")], [])
    return placed.select("conv_id", "place", "h1", "h2", "n_bytes", "last")


# --- the sketch ---------------------------------------------------------------

def _cells(p1: np.ndarray, p2: np.ndarray, width: int) -> np.ndarray:
    """2 x n cells of prefix digests: one in each row of the sketch, numbered through."""
    return np.stack([p1 & (width - 1), width + (p2 & (width - 1))])


def _met(width: int):
    """(slice, once, more): places in a slice of the cells met once, and of those met more often, by a run of prefixes."""
    schema = pa.schema([("slice", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])

    def told(held):
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        slices = cells // SLICE
        cuts = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1], [True]]))
        place = (cells % SLICE).astype(np.uint16)
        rows = [(int(slices[a]), place[a:b][n[a:b] == 1].tobytes(), place[a:b][n[a:b] > 1].tobytes()) for a, b in zip(cuts, cuts[1:])]
        for a in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[a:a + 256])], schema=schema)

    def run(batches):
        held, total = [], 0
        for batch in batches:
            held.append(_cells(batch.column("p1").to_numpy(), batch.column("p2").to_numpy(), width).ravel())
            total += len(held[-1])
            if total >= CELLS_PER_RUN:
                yield from told(held)
                held, total = [], 0
        if total:
            yield from told(held)
    return tidy(run)


def _merged(batches):
    """(slice, bits of the cells met more than once); input sorted by slice."""
    schema = pa.schema([("slice", pa.int64()), ("bits", pa.binary())])
    current, counts = None, None

    def told():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], schema=schema)

    for batch in batches:
        for name, once, more in zip(*(batch.column(c).to_pylist() for c in ("slice", "once", "more"))):
            if name != current:
                if current is not None and (counts > 1).any():
                    yield told()
                current, counts = name, np.zeros(SLICE, dtype=np.uint8)
            counts[np.frombuffer(more, np.uint16)] = 2
            places = np.frombuffer(once, np.uint16)
            counts[places] = np.minimum(counts[places] + 1, 2)
    if current is not None and (counts > 1).any():
        yield told()


def repeated_cells(prefixes: DataFrame, rows: int, most_cells: int) -> np.ndarray:
    """Bits of the sketch's cells that met more than one prefix of (p1, p2); 2 x most_cells / 8 bytes at most."""
    width = min(SLICE, most_cells)
    while width < min(4 * rows, most_cells):
        width *= 2
    bits = np.zeros(2 * width // 8, dtype=np.uint8)
    found = (prefixes.select("p1", "p2").mapInArrow(_met(width), "slice long, once binary, more binary")
             .repartition("slice").sortWithinPartitions("slice").mapInArrow(tidy(_merged), "slice long, bits binary"))
    for r in found.toLocalIterator():
        start = r["slice"] * SLICE // 8
        bits[start:start + SLICE // 8] = np.frombuffer(r["bits"], np.uint8)[:len(bits) - start]
    return bits


def _screened(bits):
    """Adds shared and parent_shared: may the prefix, or the one before it, have more than one member?"""
    def run(batches):
        table = bits.value
        width = len(table) * 4

        def may_repeat(a, b):
            cells = _cells(a, b, width)
            return ((table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=0)

        for batch in batches:
            p1, p2, q1, q2 = (batch.column(c).to_numpy() for c in ("p1", "p2", "q1", "q2"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may_repeat(p1, p2)), pa.array(may_repeat(q1, q2))],
                                             names=[*batch.schema.names, "shared", "parent_shared"])
    return tidy(run)


# --- digests of the conversations that end in a node ------------------------------

def _changes(columns: list[np.ndarray]) -> list[int]:
    change = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])]


def _chunks(batches):
    """(node, first id, ids joined by commas): sorted rows in chunks of at most IDS_PER_CHUNK ids."""
    schema = pa.schema([(c, pa.int64()) for c in (*KEY, "first")] + [("ids", pa.string())])
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in KEY]
        ids = batch.column("conv_id").to_numpy()
        cuts = [x for a, b in zip(*(lambda c: (c, c[1:]))(_changes(keys))) for x in range(a, b, IDS_PER_CHUNK)] + [len(ids)]
        rows = [(*(int(k[a]) for k in keys), int(ids[a]), ",".join(map(str, ids[a:b].tolist()))) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], schema=schema)


def _streamed(batches):
    """(node, digest): chunks of a node, in order, are one text joined by commas; one chunk is held at a time."""
    schema = pa.schema([(c, pa.int64()) for c in KEY] + [("ends_sha256", pa.string())])
    node, digest, done = None, None, []

    def told():
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], schema=schema)

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if key != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(done) >= 5_000:
            yield told()
            done = []
    if node is not None:
        done.append((*node, digest.hexdigest()))
        yield told()


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of (depth, p1, p2, conv_id): SHA-256 of each node's ids in order, comma-joined."""
    key = ", ".join(f"{c} long" for c in KEY)
    chunks = (ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
              .mapInArrow(tidy(_chunks), f"{key}, first long, ids string"))
    return (chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(tidy(_streamed), f"{key}, ends_sha256 string"))


# --- the trie -------------------------------------------------------------------

def prefix_trie(turns: DataFrame, turnless: DataFrame | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, depth from 1 without gaps, h1, h2, n_bytes); ``turnless``: ids (conv_id) of
    conversations without turns.  One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    mixed = turns.select("conv_id", "depth", "n_bytes", *[
        F.xxhash64(F.lit(seed), "depth", "h1", "h2").bitwiseAND(F.lit(MASK)).alias(m) for seed, m in ((1, "m1"), (2, "m2"))])
    walked = (running(mixed, "conv_id", [F.col("depth")], ["m1", "m2"])
              .select("conv_id", "depth", "n_bytes", "last", F.col("m1_total").alias("p1"), F.col("m2_total").alias("p2"),
                      *[(F.col(f"{m}_total") - F.col(m)).bitwiseAND(F.lit(MASK)).alias(q) for m, q in (("m1", "q1"), ("m2", "q2"))]))
    spark = turns.sparkSession
    n_rows = walked.count()
    sketch = spark.sparkContext.broadcast(repeated_cells(walked, n_rows, most_cells))                  # bounded by most_cells
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in walked.schema.fields) + ", shared boolean, parent_shared boolean"
    screened = materialise(walked.mapInArrow(_screened(sketch), schema), "trie-screened")
    member, single = screened.where("shared"), screened.where("not shared")
    # exact groups of the prefixes that may be shared
    nodes = materialise(member.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                                 F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("n_bytes").alias("n_bytes")), "trie-groups")
    first_single = single.where("parent_shared and depth > 1")
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = (nodes.where("depth > 1").select(*up).unionByName(first_single.select(*up))
                .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children")))
    nodes = materialise(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    # what each node adds to its subtrees, in the row of its representative; a conversation that ends alone is a leaf
    added = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).alias("childless"))
    steps = (member.unionByName(single.where("last")).select("conv_id", *KEY, "last", "shared")
             .join(added, ["conv_id", "depth"], "left")
             .select("conv_id", *KEY, "shared", F.coalesce("saved", F.lit(0)).alias("saved"),
                     F.when(F.col("last") & (~F.col("shared") | F.coalesce("childless", F.lit(False))), 1).otherwise(0).cast("long").alias("leaf")))
    below = running(steps, "conv_id", [F.col("depth").desc()], ["saved", "leaf"])
    sums = materialise(below.where("shared").groupBy(*KEY).agg(F.sum("saved_total").alias("saved_tokens"), F.sum("leaf_total").alias("n_leaves")), "trie-sums")
    # the root
    all_ids = screened.where("depth = 1").select("conv_id")
    at_root = turnless.select("conv_id") if turnless is not None else all_ids.where("false")
    root_of = all_ids.unionByName(at_root).agg(F.min("conv_id").alias("root_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    below_root = (sums.where("depth = 1").select("saved_tokens", "n_leaves")
                  .unionByName(single.where("depth = 1").select(F.lit(0).cast("long").alias("saved_tokens"), F.lit(1).cast("long").alias("n_leaves")))
                  .agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
                       F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves")))
    root_row = materialise(root_of.crossJoin(below_root), "trie-root")                                  # one row each
    root = (root_row.select(*[F.lit(0).cast(t).alias(c) for c, t in zip(KEY, ("long", "long", "long"))], F.col("root_id").alias("conv_id"),
                            F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"))
    # parents
    parent = nodes.select(*[F.col(c).alias(f"u_{c}") for c in KEY], F.col("conv_id").alias("parent_id"))
    above = (F.col("depth") - 1 == F.col("u_depth")) & (F.col("q1") == F.col("u_p1")) & (F.col("q2") == F.col("u_p2"))
    root_id = F.broadcast(root_row.select("root_id"))

    def with_parent(rows: DataFrame) -> DataFrame:
        """The parent's smallest member: the root's at depth 1, else of its group; a parent with one member has the row's own."""
        deep = rows.where("depth > 1").join(parent, above, "left").withColumn("parent_conv_id", F.coalesce("parent_id", "conv_id"))
        return deep.drop("parent_id", *[f"u_{c}" for c in KEY]).unionByName(
            rows.where("depth = 1").crossJoin(root_id).withColumnRenamed("root_id", "parent_conv_id"))

    empty = sha256(b"").hexdigest()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = (member.where("last").select(*KEY, "conv_id")
            .unionByName(at_root.select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id")))
    grouped = (with_parent(nodes).join(sums, KEY).select(*KEY, *[c for c in columns if c != "depth"])
               .unionByName(root.select(*KEY, *[c for c in columns if c != "depth"]))
               .join(id_digests(ends), KEY, "left").select(*columns, F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))
    alone = (with_parent(first_single.unionByName(single.where("depth = 1")))
             .unionByName(single.where("depth > 1 and not parent_shared").withColumn("parent_conv_id", F.col("conv_id")))
             .select("conv_id", "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"),
                     F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                     F.lit(0).cast("long").alias("saved_tokens"),
                     F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(empty)).alias("ends_sha256")))
    return grouped.unionByName(alone)


def conversation_trie(conversations: DataFrame, **columns) -> DataFrame:
    """The trie of conversations as they are; ``columns`` as of :func:`turn_digests`."""
    turns = turn_digests(conversations, **columns)
    return prefix_trie(turns.withColumnRenamed("place", "depth"))
