"""Approximate nearest neighbours by multiprobe p-stable hashing.

The measure is the inner product.  With one more component, sqrt(M^2 - |v|^2) (M: the
largest length), all vectors lie on a sphere of radius M, and the largest inner product is the
smallest Euclidean distance to the query, scaled to length M, with a 0 added.  That distance is hashed.

1. A table has several p-stable hashes floor((a.v + b) / w), a Gaussian (the directions of all tables
   are made orthogonal).  Their values name a vector's bucket in that table; every vector is in every table.
2. For a query, the chance that a neighbour of similarity s lies in a bucket is a product over the hashes,
   as a.neighbour is normal around s (a.query).  Buckets are visited in the order of that chance until
   their sum reaches the success wanted of a table.
3. s, the number of hashes and the success are fitted on a bounded sample (``sample_rows``): the most hashes whose visits
   stay within ``visits`` a query on average, and the least success that finds the share ``recall``
   of the sample's true neighbours.  The average only chooses the hashes: no query's visits are cut.
4. Vectors and visits meet by bucket (a shuffle).  Each task computes inner products in double
   precision, block by block, and keeps the nearest of each query; the tables' candidates are merged.

Buckets of more than ``block_rows`` vectors (they are counted) are split into blocks, each
of which gets the bucket's visits, so a hot bucket is many tasks and nothing is left out.  Equal vectors are
one class throughout: a vector that a third of the rows hold is compared once, and its rows join the result at the end.

What reaches the driver: the sample, and one count per bucket (``most_cells`` a table at most).

Defined results: null, empty and zero vectors, and those holding null or non-finite components, take no part;
a shorter vector counts as filled up with zeros; rows with a null id take no part; repeated rows count once;
an id with several vectors is a candidate with each, is asked with each, and the nearest of
them count; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialise, tidy

_normal = np.vectorize(lambda x: 0.5 * (1 + erf(x / sqrt(2))))
GRID = np.linspace(-8, 8, 3201)
GRID_NORMAL = _normal(GRID)


def normal(x: np.ndarray) -> np.ndarray:
    return np.interp(x, GRID, GRID_NORMAL)


@dataclass
class Index:
    """Hashes of every table, and how queries visit them."""
    directions: np.ndarray        # tables x hashes x (dimension + 1)
    offset: np.ndarray            # tables x hashes
    width: np.ndarray
    low: np.ndarray               # first and number of the values of each hash; those outside count as the outermost
    values: np.ndarray
    radius: float
    similarity: float             # of the neighbours looked for, as a cosine on the sphere
    success: float                # of one table

    @property
    def tables(self) -> int:
        return len(self.directions)

    def on_sphere(self, vectors: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.radius ** 2 - (vectors * vectors).sum(axis=1), 0))
        return np.column_stack([vectors, last])

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table."""
        found = []
        placed = self.on_sphere(vectors)
        for t in range(self.tables):
            value = np.floor((placed @ self.directions[t].T + self.offset[t]) / self.width[t]) - self.low[t]
            value = np.clip(value, 0, self.values[t] - 1).astype(np.int64)
            found.append(value @ self.steps(t))
        return np.stack(found, axis=1)

    def steps(self, t: int) -> np.ndarray:
        return np.concatenate([[1], np.cumprod(self.values[t][::-1])[:-1]])[::-1].astype(np.int64)

    def chances(self, vectors: np.ndarray, t: int) -> np.ndarray:
        """Chance of each bucket of a table, for each query, to hold a neighbour."""
        length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        middle = self.similarity * (vectors / length * self.radius) @ self.directions[t][:, :-1].T
        spread = self.radius * sqrt(max(1 - self.similarity ** 2, 1e-6))
        chance = np.ones((len(vectors), 1))
        for k, n in enumerate(self.values[t]):
            edges = (self.low[t, k] + np.arange(n + 1)) * self.width[t, k] - self.offset[t, k]
            below = normal((edges[None] - middle[:, k:k + 1]) / spread)
            below[:, 0], below[:, -1] = 0, 1
            chance = (chance[:, :, None] * np.diff(below, axis=1)[:, None, :]).reshape(len(vectors), -1)
        return chance

    def visits(self, vectors: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, bucket) visits of a table, each query's in order of chance."""
        chance = self.chances(vectors, t)
        order = np.argsort(-chance, axis=1, kind="stable")
        ranked = np.take_along_axis(chance, order, axis=1)
        used = np.cumsum(ranked, axis=1) - ranked < self.success
        query, place = np.nonzero(used)
        return query, order[query, place]


def fit_index(sample: np.ndarray, rows: int, radius: float, neighbours: int, tables: int, visits: float, recall: float,
              width: float, most_cells: int, seed: int) -> Index:
    """An index for ``rows`` vectors, fitted on a sample of them."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    asked = sample[:: max(1, len(sample) // 256)][:256]
    scores = asked @ sample.T
    length = np.sqrt((asked * asked).sum(axis=1))
    scores[np.arange(len(asked)), np.arange(len(asked)) * max(1, len(sample) // 256)] = -np.inf
    near = min(len(sample) - 1, max(1, round(neighbours * len(sample) / rows)))
    true = np.argsort(-scores, axis=1)[:, :min(len(sample) - 1, neighbours)]
    cosines = np.sort(scores, axis=1)[:, -near] / (length * radius) if near else np.ones(len(asked))
    similarity = float(np.clip(np.quantile(cosines, 0.1), 0.05, 0.999))
    most = int(np.log2(most_cells))
    gauss = rng.normal(size=(dim + 1, tables * most))
    if tables * most <= dim + 1:
        gauss = np.linalg.qr(gauss)[0] * sqrt(dim + 1)
    lines = gauss.T.reshape(tables, most, dim + 1)

    def index(hashes: int, success: float) -> Index:
        directions = lines[:, :hashes]
        found = Index(directions, *(np.zeros((tables, hashes)) for _ in range(4)), radius, similarity, success)
        projected = found.on_sphere(sample) @ directions.transpose(0, 2, 1)
        found.offset = -np.median(projected, axis=1)
        found.width = np.maximum(width * projected.std(axis=1), 1e-12)
        value = np.floor((projected + found.offset[:, None]) / found.width[:, None])
        found.low, high = value.min(axis=1), value.max(axis=1)
        while (np.prod(high - found.low + 1, axis=1) > most_cells).any():      # far outliers join the outermost values
            high, found.low = np.minimum(high, np.maximum(high - 1, 0)), np.maximum(found.low, np.minimum(found.low + 1, -1))
        found.values = (high - found.low + 1).astype(np.int64)
        return found

    def found_share(ix: Index) -> tuple[float, float]:
        homes, hit, made = ix.buckets(sample), np.zeros(true.shape, dtype=bool), 0
        for t in range(ix.tables):
            query, bucket = ix.visits(asked, t)
            seen = np.zeros((len(asked), int(np.prod(ix.values[t]))), dtype=bool)
            seen[query, bucket] = True
            hit |= np.take_along_axis(seen, homes[true, t], axis=1)
            made += len(query)
        return hit.mean() if hit.size else 1.0, made / len(asked)

    for hashes in range(most, 0, -1):
        for wanted in (recall, *(1 - (1 - recall) / x for x in (1.5, 2, 3, 5, 10, 100)), 1.0):
            best = index(hashes, 1 - (1 - wanted) ** (1 / tables))
            share, made = found_share(best)
            if share >= recall or made > visits:
                break
        if share >= recall and made <= visits:
            break
    return best


def _matrix(column: pa.Array, dtype: str, dim: int) -> np.ndarray:
    """Binary vectors of one length as a matrix."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(dtype).reshape(len(column), dim)


def _padded(column: pa.Array, dtype: str, dim: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if (lengths == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), dtype=dtype)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def _bucket_ids(index: Index):
    def run(batches):
        for batch in batches:
            home = index.buckets(_padded(batch.column("vector"), "f8", index.directions.shape[2] - 1))
            for t in range(index.tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(home), t)), pa.array(home[:, t])], names=["tab", "bucket"])
    return tidy(run)


def _placed(index: Index, blocks: dict, dtype: str):
    """Rows (cell, asks, id, vector): each vector in its bucket of each table, each query in all it visits.
    A cell is a block of a bucket."""
    schema = pa.schema([("cell", pa.int64()), ("asks", pa.int32()), ("id", pa.int64()), ("vector", pa.binary())])
    dim = index.directions.shape[2] - 1
    cells = [int(np.prod(v)) for v in index.values]
    first, n_blocks, total = {}, {}, 0
    for t, n in enumerate(cells):
        n_blocks[t] = np.array([blocks.get((t, b), 0) for b in range(n)], dtype=np.int64)
        first[t] = total + np.cumsum(n_blocks[t]) - n_blocks[t]
        total += int(n_blocks[t].sum())

    def rows(cell, asks, ids, vectors):
        size = vectors.shape[1] * vectors.itemsize
        for a in range(0, len(cell), 5_000):
            v = np.ascontiguousarray(vectors[a:a + 5_000])
            packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(np.arange(0, (len(v) + 1) * size, size, dtype=np.int32)),
                                                                 pa.py_buffer(v)])
            yield pa.RecordBatch.from_arrays([pa.array(cell[a:a + 5_000]), pa.array(np.full(len(v), asks, dtype=np.int32)),
                                              pa.array(ids[a:a + 5_000]), packed], schema=schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            kept = _padded(batch.column("vector"), dtype, dim)
            home = index.buckets(kept.astype("f8"))
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            for t in range(index.tables):
                yield from rows(first[t][home[:, t]] + spread % n_blocks[t][home[:, t]], 0, ids, kept)
                for a in range(0, len(asks), 256):
                    some = asks[a:a + 256]
                    query, bucket = index.visits(kept[some].astype("f8"), t)
                    n = n_blocks[t][bucket]                            # 0 for a bucket without vectors
                    cell = np.repeat(first[t][bucket] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    query = some[np.repeat(query, n)]
                    yield from rows(cell, 1, ids[query], kept[query])
    return tidy(run)


def _nearest(query: np.ndarray, other: np.ndarray, score: np.ndarray, most: int):
    """The ``most`` nearest of each query, without repetitions."""
    order = np.lexsort((other, -score, query))
    query, other, score = query[order], other[order], score[order]
    new = np.concatenate([[True], (query[1:] != query[:-1]) | (other[1:] != other[:-1])])
    query, other, score = query[new], other[new], score[new]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[rank < most], other[rank < most], score[rank < most]


def _search(dtype: str, dim: int, most: int, products: int = 2_000_000):
    schema = pa.schema([("query", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])

    def run(batches):
        cell, ids, vectors = None, [], []
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for batch in batches:
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(cells)]):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, ids, vectors = cells[a], [], []
                part = batch.slice(a, b - a)
                these, own = _matrix(part.column("vector"), dtype, dim).astype("f8"), part.column("id").to_numpy()
                if not asks[a]:
                    ids.append(own)
                    vectors.append(these)
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                step = max(1, products // len(ids[0]))
                for s in range(0, len(own), step):
                    score = these[s:s + step] @ vectors[0].T
                    last = np.partition(score, -most, axis=1)[:, -most:].min(axis=1) if score.shape[1] > most else score.min(axis=1)
                    query, at = np.nonzero(score >= (last - 1e-12 * np.abs(last))[:, None])       # all that equal the last stay
                    exact = (these[s:s + step][query] * vectors[0][at]).sum(axis=1)               # does not depend on the block
                    found.append((own[s:s + step][query], ids[0][at], exact))
                if sum(len(f[0]) for f in found[1:]) > products:
                    found = [_nearest(*(np.concatenate(x) for x in zip(*found)), most)]
        if len(found) == 1 and not len(found[0][0]):
            return
        query, other, score = _nearest(*(np.concatenate(x) for x in zip(*found)), most)
        for a in range(0, len(query), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a:a + 50_000]) for x in (query, other, score)], schema=schema)
    return tidy(run)


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, asks: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 2,
                       visits: float = 48, recall: float = 0.94, width: float = 4.0, sample_rows: int = 4096,
                       block_rows: int = 50_000, most_cells: int = 4096, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``asks`` holds (an
    SQL condition), among all rows of other ids."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.expr(asks).cast("boolean").alias("asks"), F.col(f"`{vector_col}`").alias("vector"))
    single = isinstance(raw.schema["vector"].dataType.elementType, FloatType)
    dtype, kind = ("f4", "float") if single else ("f8", "double")
    raw = (raw.withColumn("vector", F.col("vector").cast(f"array<{kind}>")).where(F.col("id").isNotNull() & usable(F.col("vector")))
           .select("id", F.coalesce("asks", F.lit(False)).alias("asks"), "vector",
                   F.xxhash64(F.lit(1), "vector").alias("h1"), F.xxhash64(F.lit(2), "vector").alias("h2")))
    schema = "query_id long, rank int, vec_id long, score double"
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows, dim, square = raw.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(length)).first()
    if not rows:
        return spark.createDataFrame([], schema)
    # classes of equal vectors
    groups = materialise(raw.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
                         .where("n > 1").drop("n"), "ann-copies")
    members = materialise(raw.join(groups, ["h1", "h2"]).select("rep", "id", "asks").distinct(), "ann-members")
    whole = raw.join(groups, ["h1", "h2"], "left_anti").select("id", "asks", "vector").unionByName(
        raw.join(groups.drop("rep"), ["h1", "h2"], "left_semi").groupBy("h1", "h2")
        .agg(F.min("id").alias("id"), F.max("asks").alias("asks"), F.first("vector").alias("vector")).drop("h1", "h2"))
    # the index
    drawn = raw.orderBy(F.xxhash64("id", F.lit(seed)), "id", "h1").limit(sample_rows).select("vector").toPandas()["vector"]
    sample = np.zeros((len(drawn), dim))
    for i, v in enumerate(drawn):
        sample[i, :len(v)] = v
    index = fit_index(sample, rows, max(sqrt(square), 1e-300), k, tables, visits, recall, width, most_cells, seed)
    counts = whole.select("vector").mapInArrow(_bucket_ids(index), "tab long, bucket long").groupBy("tab", "bucket").count().collect()   # one row per bucket
    blocks = {(r["tab"], r["bucket"]): -(-r["count"] // block_rows) for r in counts}
    # search
    placed = whole.mapInArrow(_placed(index, blocks, dtype), "cell long, asks int, id long, vector binary")
    found = (placed.repartition("cell").sortWithinPartitions("cell", "asks")
             .mapInArrow(_search(dtype, dim, k + 1), "query long, other long, score double"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "other")
    found = (found.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"))
    # back from classes to rows
    some = (members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
            .select(F.col("rep").alias("other"), "id"))
    asking = members.where("asks").select(F.col("rep").alias("query"), F.col("id").alias("query_id"))
    named = (found.join(some, "other", "left").withColumn("vec_id", F.coalesce("id", "other")).drop("id", "other")
             .withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
             .join(asking, "query", "left").withColumn("query_id", F.coalesce("query_id", "query"))
             .where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
