from pyspark.sql import functions as F

import corpus_pipeline
from tidecast.llm.queries import ORACLE_SQL, QUERIES

from .helpers import LOWER, awkward, brute_components
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF))
    assert all(t.columns == columns for t in tables[:-1])
    given, with_lang, unlike, apart, clean, packed = tables
    assert sorted(pairs(with_lang)) == sorted((d, t) for d, t in pairs(given) if any(c.isalpha() for c in t or ""))
    largest = {}
    for d, t in pairs(with_lang):
        key = (t or "").translate(LOWER)
        largest[key] = max(d, largest.get(key, d))
    assert sorted(d for d, _ in pairs(unlike)) == sorted(largest.values())
    assert sorted(d for d, _ in pairs(apart)) == sorted({c for _, _, c in brute_components(pairs(unlike), 80, 5)})
    items = [" ".join((r["text"] or "").lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d for d, _ in pairs(clean)}
    for d, t in pairs(apart):
        text = " ".join((t or "").lower().split())
        if any(i in text for i in items):
            assert d not in left
    assert len(left) > 0.9 * apart.count()
    check_packing(pairs(clean), packed.collect())
    want = sorted(map(tuple, packed.select("doc_id", "doc_tokens").distinct().collect()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect()
    assert sorted(map(tuple, got)) == want


def test_stages_on_awkward_rows(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (awkward(spark).select(*columns), awkward(spark).select(*columns).where("false")):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test-stage")
        assert docs.columns[0] == "doc_id"
    for docs in (awkward(spark).select(*columns, F.lit(1).alias("a.b"), F.lit("x").alias("my col")),):
        for _, stage in corpus_pipeline.STAGES[2:4]:
            assert stage(spark, docs, SF).columns == docs.columns


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
