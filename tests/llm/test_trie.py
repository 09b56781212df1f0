import hashlib
import random
import zlib

import pytest

from tidecast.llm.prefix_trie import conversation_trie, prefix_trie, turn_digests
from tidecast.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, last string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(convs):
    """Nodes of {conversation: [(role, text), ...]}, as sets of rows."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, below = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves = sum(below[k][0] for k in kids) or 1
        saved = sum(below[k][1] for k in kids) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        below[node] = (leaves, saved)
        if node:
            children.setdefault(node[:-1], []).append(node)
    rows = set()
    for node, ids in members.items():
        ends = sorted(c for c in ids if len(convs[c]) == len(node))
        rows.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children.get(node, [])),
                  *below[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return rows


def table_of(spark, convs, rng=None):
    rows = [(c, i, r, t, 1, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    (rng or random.Random(0)).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("cells", [8, 1 << 20])          # 8: nearly every estimate is too large; results stay
def test_trie_equals_brute_force(spark, cells):
    rng = random.Random(cells)
    pool = [("user", "a"), ("bot", "a"), ("user", "bé"), ("", ""), ("bot", "c" * 30)]
    convs = {-7: [("user", "only")]}
    for c in range(1, 120):
        turns = [rng.choice(pool) for _ in range(rng.randrange(1, 9))]
        convs[c] = turns + [("user", f"{c} {i}") for i in range(rng.choice([0, 0, 1, 5]))]
    convs |= {c: list(convs[5]) for c in range(200, 260)}
    turns = turn_digests(table_of(spark, convs, rng)).withColumnRenamed("place", "depth")
    turnless = {900: [], 901: [], -50: []}
    got = prefix_trie(turns, spark.createDataFrame([(c,) for c in turnless], "conv_id long"), most_cells=cells)
    assert found(got) == brute_trie(convs | turnless)
    assert found(conversation_trie(table_of(spark, convs))) == brute_trie(convs)


def test_one_conversation_holds_most_rows(spark):
    """A long conversation and a copy of it lie in many partitions; many conversations end in one node."""
    convs = {3: [("u", f"t{i % 11}") for i in range(700)], 4: [("u", f"t{i % 11}") for i in range(700)], 5: [("u", "t0")]}
    convs |= {c: [("u", "t0"), ("b", "end")] for c in range(1_000, 3_500)}
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(conversation_trie(table_of(spark, convs))) == brute_trie(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 2, "u", "x"), (1, 2, "u", "x"), (2, 0, "", ""), (2, 5, "u", "x"), (None, 1, "u", "x"),
            (3, -4, None, ""), (3, None, "z", None), (3, 9, "u", "y" * 100_000)]
    data = spark.createDataFrame([(*r, 7, "l") for r in rows], SCHEMA)
    convs = {1: [("", ""), ("u", "x"), ("u", "x")], 2: [("", ""), ("u", "x")], 3: [("z", ""), ("", ""), ("u", "y" * 100_000)]}
    assert found(conversation_trie(data)) == brute_trie(convs)
    assert conversation_trie(data.where("false")).count() == 0
    assert conversation_trie(data.where("conv_id is null")).count() == 0


def test_query_rebuilds_conversations(spark):
    convs = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    assert found(QUERIES["op11_prefix_trie"](spark, SF)) == brute_trie(rebuilt)
