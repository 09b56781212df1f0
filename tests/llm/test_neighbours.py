import numpy as np

from tidecast.llm.multiprobe import fit_index, nearest_neighbours
from tidecast.llm.queries import QUERIES

ASKS = "vec_id % 20 = 0"


def brute(rows, k=20):
    """query id -> nearest (id, score), ties to the smaller id."""
    rows = [(i, np.array(v, dtype=float)) for i, v in rows]
    return {q: sorted(((i, float(v @ w)) for i, w in rows if i != q), key=lambda x: (-x[1], x[0]))[:k] for q, v in rows if q % 20 == 0}


def check(got, want, least):
    """Rows are well formed, scores true; the share of ``want`` found is at least ``least``."""
    hits = total = 0
    for q, best in want.items():
        rows = sorted(((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q))
        assert [r for r, _, _ in rows] == list(range(1, len(best) + 1))
        assert [(s, -i) for _, i, s in rows] == sorted(((s, -i) for _, i, s in rows), reverse=True)
        assert q not in {i for _, i, _ in rows} and len({i for _, i, _ in rows}) == len(rows)
        hits += len({i for _, i, _ in rows} & {i for i, _ in best})
        total += len(best)
    assert len(got) == total
    assert hits >= least * total


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = QUERIES["op12_nearest_neighbours"](spark, sf).collect()
    check(got, want, 0.9)
    vectors = {i: np.array(v, dtype=float) for i, v in rows}
    assert all(abs(vectors[r["query_id"]] @ vectors[r["vec_id"]] - r["score"]) < 1e-12 for r in got)


def test_copies_lengths_and_split_buckets(spark):
    """A third of the rows hold one vector, lengths differ, buckets are split: still near brute force, copies exactly."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)) * rng.uniform(0.2, 3)) for i in range(1_200)]
    rows += [(i, centres[0]) for i in range(1_200, 1_800)]
    data = spark.createDataFrame([(i, [float(x) for x in v], "b") for i, v in rows], "vec_id long, embedding array<double>, bucket string")
    got = nearest_neighbours(data, ASKS, block_rows=50).collect()
    check(got, brute(rows), 0.9)
    copies = {i for i in range(1_200, 1_800)}
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    for q in (1_200, 1_300):                                       # among equal scores the smallest ids
        same = sorted(v for (a, v), s in scores.items() if a == q and v in copies)
        assert same == [i for i in range(1_200, 1_801) if i != q][:len(same)]


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [2.0]), (21, [0.0, 1.0]), (22, [0.0, 1.0]), (-20, [0.5, 0.5]), (40, None)]
    data = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, query int")
    got = nearest_neighbours(data, ASKS).collect()
    full = [(0, [1, 0]), (1, [.5, .5]), (20, [2, 0]), (21, [0, 1]), (22, [0, 1]), (-20, [.5, .5])]
    want = [(q, n + 1, i, s) for q, best in brute(full).items() for n, (i, s) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert nearest_neighbours(data.where("false"), ASKS).count() == 0
    assert nearest_neighbours(data.where("vec_id = 0"), ASKS).count() == 0


def test_visits_come_in_order_of_their_chance():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(500, 8))
    index = fit_index(sample, 500, float(np.sqrt((sample ** 2).sum(axis=1).max())), 10, 2, 48, 0.9, 4.0, 64, 3)
    for t in range(2):
        chance = index.chances(sample[:20], t)
        assert np.allclose(chance.sum(axis=1), 1)
        query, bucket = index.visits(sample[:20], t)
        for q in range(20):
            seen = chance[q, bucket[query == q]]
            assert (np.diff(seen) <= 1e-12).all()
            assert seen.sum() >= index.success - 1e-9 and seen[:-1].sum() < index.success
