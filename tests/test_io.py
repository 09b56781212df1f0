"""Sources, sinks, model persistence and the streaming job."""

import json
import os

from pyspark.ml.regression import LinearRegressionModel
import pytest
from pyspark.sql import functions as F

from tidecast.params import ForecastParams
from tidecast.sources import files, sinks
from tidecast.sources.tables import order_facts, table
from tidecast.streaming.period_stream import run_available
from tidecast.operators import learn

from .conftest import SF_SMALL


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_word_score_files(spark, tmpdir_path):
    d = tmpdir_path
    _write(os.path.join(d, "2024-01.json"), '{\n  "rain": 0.5,\n  "sun": 1.0\n}')
    _write(os.path.join(d, "2024-02.json"), '{"rain": 0.25}')
    _write(os.path.join(d, "2024-03.json"), '{"rain": "high"}')        # non-numeric value
    _write(os.path.join(d, "2024-04.json"), '{broken')                  # malformed
    _write(os.path.join(d, "2024-05.json"), '42')                       # scalar
    good, bad = files.load_word_scores(spark, d)
    assert sorted(map(tuple, good.collect())) == [("2024-01", "rain", 0.5), ("2024-01", "sun", 1.0),
                                                  ("2024-02", "rain", 0.25)]
    assert sorted(r["month"] for r in bad.collect()) == ["2024-03", "2024-04", "2024-05"]
    one, _ = files.load_word_scores(spark, d, month="2024-02")
    assert [tuple(r) for r in one.collect()] == [("2024-02", "rain", 0.25)]


def test_word_list_files(spark, tmpdir_path):
    d = tmpdir_path
    _write(os.path.join(d, "2024-01.json"), '["rain", "sun"]')
    _write(os.path.join(d, "2024-02.json"), '{"rain": 1, "wind": "x"}')  # object: keys are the words
    _write(os.path.join(d, "2024-03.json"), '"just text"')
    good, bad = files.load_word_lists(spark, d)
    got = sorted((r["month"], r["word"]) for r in good.collect())
    assert got == [("2024-01", "rain"), ("2024-01", "sun"), ("2024-02", "rain"), ("2024-02", "wind")]
    assert [r["month"] for r in bad.collect()] == ["2024-03"]


def test_one_bad_value_leaves_the_rest(spark, tmpdir_path):
    d = tmpdir_path
    _write(os.path.join(d, "2024-01.json"), ' \n{"a": 1, "b": "0.5", "c": true, "d": null, "e": [1], "f": {"g": 1}, "h": 1e3, "i": -0.25, "": 2}')
    _write(os.path.join(d, "2024-02.json"), '{"a": 1, "a": 2}')                # a word twice
    _write(os.path.join(d, "2024-03.json"), '{}')
    _write(os.path.join(d, "2024-04.json"), '')
    _write(os.path.join(d, "2024-05.json"), '[7, "x", ["y"], {"z": 1}, null, true, "x"]')
    good, bad = files.load_word_scores(spark, d)
    assert sorted(map(tuple, good.collect())) == [("2024-01", "", 2.0), ("2024-01", "a", 1.0), ("2024-01", "h", 1000.0), ("2024-01", "i", -0.25)]
    wrong = {(r["month"], r["word"]): r["value"] for r in bad.collect()}
    assert {k: wrong[k] for k in wrong if k[0] == "2024-01"} == {
        ("2024-01", "b"): '"0.5"', ("2024-01", "c"): "true", ("2024-01", "d"): "null", ("2024-01", "e"): "[1]", ("2024-01", "f"): '{"g":1}'}
    assert {k[0] for k in wrong if k[1] is None} >= {"2024-02", "2024-05"} and "2024-03" not in {k[0] for k in wrong}
    words, odd = files.load_word_lists(spark, d)
    got = sorted((r["month"], r["pos"], r["word"]) for r in words.collect() if r["month"] == "2024-05")
    assert got == [("2024-05", 1, "7"), ("2024-05", 2, "x"), ("2024-05", 6, "true"), ("2024-05", 7, "x")]
    assert sorted(r["value"] for r in odd.collect() if r["month"] == "2024-05") == ['["y"]', "null", '{"z":1}']


def test_word_files_are_replaced_by_month(spark, tmpdir_path):
    scores = spark.createDataFrame([("2024-01", "b", 0.5), ("2024-01", "a", 1.0), ("2024-02", "a", 0.25), (None, "a", 1.0)], "month string, word string, score double")
    sinks.write_word_files(sinks.score_files(scores), tmpdir_path)
    sinks.write_word_files(sinks.score_files(scores.where("month = '2024-02'").withColumn("score", F.lit(0.75))), tmpdir_path)
    good, bad = files.load_word_scores(spark, tmpdir_path)
    assert sorted(map(tuple, good.collect())) == [("2024-01", "a", 1.0), ("2024-01", "b", 0.5), ("2024-02", "a", 0.75)]
    assert bad.count() == 0
    assert sorted(f for f in os.listdir(tmpdir_path) if not f.startswith(".")) == ["2024-01.json", "2024-02.json"]


def test_sales_csv_variants(spark, tmpdir_path):
    d = tmpdir_path
    assert files.load_sales_csv(spark, d).count() == 0                    # empty folder
    _write(os.path.join(d, "b.csv"), "month,sales\n2024-01-01,10\n")
    _write(os.path.join(d, "a.csv"), "date,sales\n2024-02-17,5\n2024-02-20,7\n")
    rows = sorted((str(r["month"]), r["sales"]) for r in files.load_sales_csv(spark, d).collect())
    assert rows == [("2024-02-01", 5.0), ("2024-02-01", 7.0)]             # floored, not summed


def test_item_dump_and_sinks(spark, tmpdir_path):
    d = tmpdir_path
    dump = os.path.join(d, "dump.jsonl")
    _write(dump, json.dumps({"id": "v1", "title": "t", "upload_date": "20240105", "view_count": None,
                             "webpage_url": "", "uploader": "", "channel": "ch"}) + "\n\nnot json\n"
           + "".join(json.dumps({"id": f"v{i}", "view_count": v}) + "\n" for i, v in enumerate(["7", 5.0, "many"], 2)))
    raw, bad = files.load_item_dump(spark, dump)
    assert [r["line"] for r in bad.collect()] == ["not json"]
    assert [(r["id"], r["view_count"]) for r in raw.orderBy("seq_no").collect()] == [
        ("v1", None), ("v2", 7), ("v3", 5), ("v4", None)]
    raw = raw.where("id = 'v1'")
    from tidecast.operators.items import normalise_record
    rec = normalise_record(raw, keep=["id"]).first()
    assert rec["url"] == "https://www.youtube.com/watch?v=v1" and rec["channel_title"] == "ch" and rec["view_count"] == 0
    assert rec["upload_date"] == "2024-01-05T00:00:00"
    empty = raw.limit(0)
    assert sinks.write_items(empty, os.path.join(d, "j"), os.path.join(d, "c")) is False
    assert not os.path.exists(os.path.join(d, "c"))


def test_importance_and_report_roundtrip(spark, tmpdir_path):
    imp = spark.createDataFrame([("a", 1.0, 2.0, "positive"), ("b", 0.5, -1.0, "negative")],
                                files.IMPORTANCE_SCHEMA)
    p = os.path.join(tmpdir_path, "scores")
    sinks.write_word_scores(imp, p)
    assert sorted(map(tuple, files.load_importance(spark, p).collect())) == sorted(map(tuple, imp.collect()))
    rep = spark.createDataFrame([("2024-02", "B"), ("2024-01", "A")], "month string, report string")
    rp = os.path.join(tmpdir_path, "report")
    sinks.write_report(rep, rp)
    text = "".join(open(os.path.join(rp, f)).read() for f in sorted(os.listdir(rp)) if f.startswith("part"))
    assert text == "A\nB\n"


def test_forecast_and_model_persistence(spark, tmpdir_path):
    facts = order_facts(spark, SF_SMALL)
    pred, rec = learn.forecast_from_facts(facts, ForecastParams(freq="monthly", max_iter=10), "huber")
    assert rec["status"] == "success" and rec["predicted_value"] is not None
    assert pred.count() == rec["n_samples"]
    path = sinks.save_model(rec["_model"], tmpdir_path)
    loaded = sinks.load_latest_model(spark, tmpdir_path, LinearRegressionModel)
    assert loaded.coefficients == rec["_model"].coefficients
    assert path.endswith(os.path.basename(sinks.latest_model_path(spark, tmpdir_path)))
    out = os.path.join(tmpdir_path, "pred")
    sinks.write_prediction(spark, rec, out, "0:00:01")
    back = spark.read.json(out).first()
    assert back["status"] == "success" and back["prediction"]["last_period"] == rec["last_period"]


def test_stream_equals_batch_in_any_session_zone(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
    try:
        schema = table(spark, SF_SMALL, "events").schema
        got = run_available(spark, SF_SMALL, "events.parquet", schema, "ts", ["event_type"], "value")
        got = {(str(r["period"]), r["event_type"]): r["n_events"] for r in got.collect()}
        exp = (table(spark, SF_SMALL, "events").groupBy(F.to_date("ts").alias("d"), "event_type").count()
               .collect())
        assert got == {(str(r["d"]), r["event_type"]): r["count"] for r in exp}
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_stream_upserts_across_micro_batches(spark, tmpdir_path):
    # two files arrive as two micro-batches; the same day is updated by both
    src = os.path.join(tmpdir_path, "src")
    ev = table(spark, SF_SMALL, "events")
    first_day = ev.agg(F.min(F.to_date("ts"))).first()[0]
    day = ev.where(F.to_date("ts") == F.lit(first_day))
    ids = [r[0] for r in day.select("event_id").orderBy("event_id").collect()]
    half = ids[len(ids) // 2]
    day.where(F.col("event_id") < half).coalesce(1).write.parquet(os.path.join(src, "a"))
    day.where(F.col("event_id") >= half).coalesce(1).write.parquet(os.path.join(src, "b"))
    import glob
    import shutil
    flat = os.path.join(tmpdir_path, "flat")
    os.makedirs(flat)
    for i, f in enumerate(sorted(glob.glob(os.path.join(src, "*", "part-*.parquet")))):
        shutil.copy(f, os.path.join(flat, f"events-{i}.parquet"))
    from tidecast.streaming import period_stream as ps
    out = ps.run_available(spark, flat, "events-*.parquet", ev.schema, "ts", [], "value", files_per_batch=1)
    assert out.count() == 1 and out.first()["n_events"] == len(ids)


def test_stream_result_is_the_same_for_any_batches(spark, tmpdir_path):
    """1, 4 and 40 files in shuffled name order, one file a batch: nothing is late, nothing is lost."""
    import glob
    import random
    import shutil
    from tidecast.streaming import period_stream as ps
    orders = table(spark, SF_SMALL, "orders")
    want = {(str(r["d"]), r["n"]) for r in orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for n in (1, 4, 40):
        src, flat = os.path.join(tmpdir_path, f"src{n}"), os.path.join(tmpdir_path, f"flat{n}")
        orders.repartitionByRange(n, "o_orderdate").write.parquet(src)
        files_ = sorted(glob.glob(os.path.join(src, "part-*.parquet")))
        random.Random(n).shuffle(files_)
        os.makedirs(flat)
        for i, f in enumerate(files_):
            shutil.copy(f, os.path.join(flat, f"orders-{i:03d}.parquet"))
        out_path = os.path.join(tmpdir_path, f"out{n}")
        out = ps.run_available(spark, flat, "orders-*.parquet", orders.schema, "o_orderdate", [], "o_totalprice",
                               files_per_batch=max(1, n // 10), out_path=out_path, distinct_col="o_custkey")
        assert {(str(r["period"]), r["n_events"]) for r in out.collect()} == want
        assert out.where("approx_distinct > n_events or approx_distinct < 1").count() == 0
        ps.compact(spark, out_path, [])
        again = ps.result(spark, out_path, [])
        assert len(ps.live_folders(spark, out_path)) == 1
        assert {(str(r["period"]), r["n_events"]) for r in again.collect()} == want


def test_compaction_is_atomic_and_bounded(spark, tmpdir_path):
    """Many batches leave few folders; a compaction that ends half-way, and a batch that runs again, change nothing."""
    from tidecast.streaming import period_stream as ps
    orders = table(spark, SF_SMALL, "orders")
    days = orders.select(F.to_date("o_orderdate").alias("period"), "o_custkey", "o_totalprice", F.pmod("o_orderkey", F.lit(30)).alias("b")).persist()
    want = {(r["period"], r["n"], r["c"]) for r in days.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("c")).collect()}
    out_path = os.path.join(tmpdir_path, "out")

    def write(b):
        part = ps.period_partials(days.where(F.col("b") == b).withColumn("ts", F.col("period").cast("timestamp_ntz")), "ts", [], "o_totalprice",
                                  exact_distinct="o_custkey")
        part.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/batch={b:012d}")

    def got():
        return {(r["period"], r["n_events"], r["n_distinct"]) for r in ps.result(spark, out_path, []).collect()}

    for b in range(30):
        write(b)
        if b % 5 == 4:
            ps.compact(spark, out_path, [])
            assert len([f for f in os.listdir(out_path) if "=" in f]) <= 12
    assert got() == want
    before = ps.live_folders(spark, out_path)
    real, ps.commit = ps.commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    try:
        write(30)                                                      # an empty batch
        with pytest.raises(OSError):
            ps.compact(spark, out_path, [])
    finally:
        ps.commit = real
    write(3)                                                           # covered by the manifest: not read again
    assert ps.live_folders(spark, out_path)[:len(before)] == before and got() == want
    ps.compact(spark, out_path, [])
    assert got() == want and len(ps.live_folders(spark, out_path)) == 1
    with pytest.raises(RuntimeError):
        ps.commit(spark, out_path, 1 + len(range(6)), {"through": 0, "folders": []})
    days.unpersist()


def test_unfinished_saves_are_skipped(spark, tmpdir_path):
    import datetime as dt
    facts = order_facts(spark, SF_SMALL)
    _, rec = learn.forecast_from_facts(facts, ForecastParams(freq="monthly", max_iter=5), "huber")
    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    first = sinks.save_model(rec["_model"], tmpdir_path, now, rec["_state"])
    second = sinks.save_model(rec["_model"], tmpdir_path, now, {**rec["_state"], "ylo": -7.0})       # the same second
    assert {os.path.basename(m) for m in sinks.committed_models(spark, tmpdir_path)} == {os.path.basename(first), os.path.basename(second)}
    newest = max(first, second)
    os.makedirs(os.path.join(tmpdir_path, "model_20990101_000000_000000_ffffffff", "model"))          # died half-way
    model, state = sinks.load_latest(spark, tmpdir_path, LinearRegressionModel)
    assert model.coefficients == rec["_model"].coefficients
    assert state["ylo"] == (-7.0 if newest == second else rec["_state"]["ylo"])


def test_grains_from_one_scan(spark):
    """Every grain equals its own aggregation; the daily table reads the orders once; names count as ids too."""
    import contextlib
    import io
    from tidecast.operators import aggregate as agg
    from tidecast.operators import grains
    facts = order_facts(spark, SF_SMALL)
    named = facts.withColumn("customer_id_x", F.concat(F.lit("c"), "customer_id_x"))
    for source in (facts, named):
        for freq, got in grains.full_datasets(source).items():
            want = agg.full_dataset(source, freq)
            assert got.columns == want.columns
            a, b = ({str(r["period"]): r for r in x.collect()} for x in (got, want))
            assert a.keys() == b.keys()
            for k in a:
                assert all(x == pytest.approx(y, rel=1e-9, abs=1e-6) if isinstance(y, float) else x == y for x, y in zip(a[k], b[k]))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        grains.daily_partials(order_facts(spark, SF_SMALL, category=False, segment=False), []).explain("formatted")
    scans = text.getvalue().split("== Physical Plan ==")[1].split("\n\n")[0]
    assert scans.count("Scan parquet") == 2 and text.getvalue().count("orders.parquet") == 1          # orders and lineitem


def test_orders_csv_by_name(spark, tmpdir_path):
    names = [f.name for f in files.ORDER_SCHEMA][::-1] + ["note"]
    row = {"order_id": "1", "order_date": "2024-01-02", "order_total": "3.5", "quantity": "2", "customer_id_x": "77", "note": "extra"}
    path = os.path.join(tmpdir_path, "orders.csv")
    _write(path, ",".join(names) + "\n" + ",".join(row.get(n, "") for n in names) + "\n")
    got = files.load_orders_csv(spark, path).first()
    assert (got["quantity"], got["customer_id_x"], got["order_total"], got["year_month"]) == (2.0, "77", 3.5, "2024-01")
    assert "note" not in got.asDict()
    _write(path, "order_id,order_date\n1,2024-01-02\n")
    with pytest.raises(ValueError, match="order_total"):
        files.load_orders_csv(spark, path)
