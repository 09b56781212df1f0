"""Items that arrive in batches: any split and order gives the batch result; a dead job changes nothing."""

import os
import random

import pytest

from tidecast.operators import item_store as store
from tidecast.operators import items as it

SCHEMA = "url string, seq_no long, title string, view_count long"


def rows():
    rng = random.Random(3)
    return [(f"u{rng.randrange(40)}" if i % 9 else "hot", i, f"t{i}", rng.randrange(100)) for i in range(400)] + [(None, 900, "n", 1), (None, 901, "m", 2)]


def table(df):
    return sorted(map(tuple, df.select("url", "seq_no", "title", "view_count").collect()), key=str)


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 3), (3, 7)])
def test_any_split_and_order(spark, tmpdir_path, seed, batches):
    all_rows = rows()
    expected = table(it.dedupe_first(spark.createDataFrame(all_rows, SCHEMA)))
    shuffled = random.Random(seed).sample(all_rows, len(all_rows))
    for i in range(batches):
        store.upsert(spark.createDataFrame(shuffled[i::batches], SCHEMA), tmpdir_path, n_buckets=8)
    assert table(store.items(spark, tmpdir_path)) == expected
    store.upsert(spark.createDataFrame(shuffled[:50], SCHEMA), tmpdir_path)                 # a batch again
    assert table(store.items(spark, tmpdir_path)) == expected


def test_only_touched_buckets_are_written(spark, tmpdir_path):
    store.upsert(spark.createDataFrame(rows(), SCHEMA), tmpdir_path, n_buckets=16)
    before = store._versions(spark, tmpdir_path)[-1][1]["buckets"]
    assert store.upsert(spark.createDataFrame([("u1", -1, "first", 5)], SCHEMA), tmpdir_path) == 1
    after = store._versions(spark, tmpdir_path)[-1][1]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.items(spark, tmpdir_path).where("url = 'u1'").first()["title"] == "first"


def test_a_job_that_dies_before_its_commit(spark, tmpdir_path, monkeypatch):
    store.upsert(spark.createDataFrame(rows()[:200], SCHEMA), tmpdir_path, n_buckets=4)
    expected = table(store.items(spark, tmpdir_path))

    def dies(*a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", dies)
        with pytest.raises(RuntimeError):
            store.upsert(spark.createDataFrame(rows()[200:], SCHEMA), tmpdir_path)
    assert table(store.items(spark, tmpdir_path)) == expected
    store.upsert(spark.createDataFrame(rows()[200:], SCHEMA), tmpdir_path)
    assert table(store.items(spark, tmpdir_path)) == table(it.dedupe_first(spark.createDataFrame(rows(), SCHEMA)))
    live = {f"{d}/{b}" for d in os.listdir(tmpdir_path) if d.startswith("upsert=") for b in os.listdir(os.path.join(tmpdir_path, d)) if "=" in b}
    named = {f for _, m in store._versions(spark, tmpdir_path) for f in m["buckets"].values()}
    assert live == named                                                                    # what the dead job left is gone


def test_empty_batches_ties_and_new_columns(spark, tmpdir_path):
    assert store.items(spark, tmpdir_path) is None
    store.upsert(spark.createDataFrame([], SCHEMA), tmpdir_path, n_buckets=4)
    assert store.items(spark, tmpdir_path).count() == 0
    ties = [("a", 1, "x", 1), ("a", 1, "y", 2), ("a", None, "z", 3)]
    for t in ties:
        store.upsert(spark.createDataFrame([t], SCHEMA), tmpdir_path)
    other = os.path.join(tmpdir_path, "other")
    store.upsert(spark.createDataFrame(ties[::-1], SCHEMA), other, n_buckets=4)
    assert table(store.items(spark, tmpdir_path)) == table(store.items(spark, other)) and len(table(store.items(spark, other))) == 1
    store.upsert(spark.createDataFrame([("b", 2, "new")], "url string, seq_no long, `a.b` string"), other)
    assert {r["url"]: r["a.b"] for r in store.items(spark, other).collect()} == {"a": None, "b": "new"}
