"""The command-line jobs on the reference's file formats."""

import json
import os

from tidecast.__main__ import main
from tidecast.sources.tables import order_facts

from .conftest import SF_SMALL


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_cli_forecast_from_order_csv(spark, tmpdir_path, capsys):
    csv = os.path.join(tmpdir_path, "orders_csv")
    order_facts(spark, SF_SMALL).write.option("header", True).csv(csv)
    main(["forecast", "--orders", csv, "--freq", "monthly", "--out", os.path.join(tmpdir_path, "out")])
    res = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert res["status"] == "success" and res["freq"] == "monthly"


def test_cli_words_from_json_files(spark, tmpdir_path, capsys):
    wdir, sdir = os.path.join(tmpdir_path, "w"), os.path.join(tmpdir_path, "s")
    os.makedirs(wdir), os.makedirs(sdir)
    months = [f"2023-{m:02d}" for m in range(1, 13)] + [f"2024-{m:02d}" for m in range(1, 7)]
    vocab = ["rain", "sun", "snow", "wind", "fog"]
    lines = ["month,sales"]
    for i, m in enumerate(months):
        words = [w for j, w in enumerate(vocab) if (i + j) % 3 != 0]
        _write(os.path.join(wdir, f"{m}.json"), json.dumps(words if i % 2 else {w: 1 for w in words}))
        lines.append(f"{m}-01,{1000 + 100 * len(words) + (50 if 'sun' in words else 0)}")
    _write(os.path.join(wdir, "2024-07.json"), "{broken")
    _write(os.path.join(sdir, "sales.csv"), "\n".join(lines) + "\n")
    main(["words", "--words", wdir, "--sales", sdir, "--method", "ridge", "--top", "3",
          "--out", os.path.join(tmpdir_path, "out")])
    res = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert len(res["top_words"]["all"]) == 3 and res["quarantined_files"] == 1
    assert res["n_months"] == len(months)


def test_cli_items_from_dump(spark, tmpdir_path, capsys):
    dump = os.path.join(tmpdir_path, "dump.jsonl")
    recs = [{"keyword": "k", "id": "a", "title": "t", "upload_date": "20240105", "view_count": 5},
            {"keyword": "k", "id": "b", "title": "t", "upload_date": "20240106", "view_count": 9,
             "webpage_url": "https://www.youtube.com/watch?v=a"},
            {"keyword": "k", "id": "c", "upload_date": "", "view_count": None}]
    _write(dump, "\n".join(json.dumps(r) for r in recs) + "\nnot json\n")
    main(["items", "--dump", dump, "--out", os.path.join(tmpdir_path, "out")])
    res = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert res == {"n_collected": 2, "n_unique": 1, "quarantined_lines": 1}      # 'c' has no date; a and b share a URL


def test_cli_word_forecast_from_score_files(spark, tmpdir_path, capsys):
    sdir, sales_dir = os.path.join(tmpdir_path, "scores"), os.path.join(tmpdir_path, "sales")
    os.makedirs(sdir), os.makedirs(sales_dir)
    months = [f"2023-{m:02d}" for m in range(1, 13)] + [f"2024-{m:02d}" for m in range(1, 7)]
    lines = ["month,sales"]
    for i, m in enumerate(months):
        scores = {"rain": round(0.1 * (i % 5), 2), "sun": round(1 - 0.05 * i, 2)}
        _write(os.path.join(sdir, f"{m}.json"), json.dumps(scores))
        lines.append(f"{m}-01,{1000 + 37 * i + 200 * scores['rain']}")
    _write(os.path.join(sdir, "2024-07.json"), '{"rain": 0.3, "sun": 0.2}')   # next month's words
    _write(os.path.join(sdir, "bad.json"), "[1, 2")
    _write(os.path.join(sales_dir, "sales.csv"), "\n".join(lines) + "\n")
    out = os.path.join(tmpdir_path, "out")
    main(["word-forecast", "--scores", sdir, "--sales", sales_dir, "--out", out])
    res = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert res["status"] == "success" and res["n_samples"] == len(months) - 12
    doc = json.loads(open([os.path.join(out, "prediction_words", f) for f in
                           os.listdir(os.path.join(out, "prediction_words")) if f.endswith(".json")][0]).readline())
    assert doc["status"] == "success" and doc["data_info"]["n_word_columns"] == 2
    assert doc["data_info"]["source_month"] == "2024-07"          # next month's own word file
