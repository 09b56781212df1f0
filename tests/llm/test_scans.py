import random
import textwrap

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.llm.license_scan import ENTIRE, known_licenses, scan_licenses
from tidecast.llm.queries import ORACLE_SQL
from tidecast.llm.spaced_seeds import decontaminate
from tidecast.llm.url_rules import apply_url_rules

from .helpers import awkward, empty


def brute_url(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        rest = rest.split("#")[0].split("?")[0]
        host, slash, tail = rest.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = slash + tail
    fits = [r for r in rules if (r[0] == "" or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r[0]), len(r[1]), r[2] == "block"))
    return host, path, best[0] + best[1], best[2]


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(2)
    labels = ["a", "b", "net", "example", "x-y"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    paths = ["", "/", "/en/", "/en/x", "/de", "/EN/", "/en"]
    rules = list({(rng.choice(hosts), rng.choice(["/", "/en/", "/en/x", ""])): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    rules = [(h, p, v) for (h, p), v in rules] + [("net", "/", "allow"), ("net", "/", "block")]
    pages = [(i, "http" + rng.choice(["://", "s://"]) + rng.choice(hosts).replace("net", rng.choice(["net", "NET"])) + rng.choice(paths)
              + rng.choice(["", "?q=/en/", "#f", "?a://b"])) for i in range(3000)]
    pages += [(None, None), (1, ""), (2, "no scheme"), (3, "://"), (4, "x://?"), (5, "x:// /en/"), (6, "a://net"), (6, "a://net")] + [
        (9000 + i, "http://hot.example.net/en/") for i in range(2000)]
    got = apply_url_rules(spark.createDataFrame([(i, u, "p", "k") for i, u in pages], "page_id long, url string, path string, key string"),
                          spark.createDataFrame(rules, "host string, path string, action string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *brute_url(u, rules)) for i, u in pages), key=repr)


def test_url_rules_empty(spark):
    none = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in apply_url_rules(pages, none).collect()] == [(1, "a.net", "/", None, "allow")]
    assert apply_url_rules(pages.where("page_id > 1"), none).count() == 0


def test_license_scan(spark):
    docs = awkward(spark, [
        (1, "Released under the MIT licence!"), (2, "prose here\n  RELEASED under -- the MIT License.\r\nmore prose"),
        (3, "Copyright 2020 Someone\nLicensed under CC BY-NC 4.0\nAll rights reserved."), (4, None), (5, ""), (6, "..."),
        (7, "we are released under the mit license today"), (None, "Released under the MIT License"),
        (8, "Released under the MIT License.\nReleased under the MIT License.")])
    got = {(r["doc_id"], r["unit"], r["line_no"], r["license"]) for r in scan_licenses(docs, known_licenses(spark)).collect()}
    assert got == {(1, "document", 0, "MIT"), (1, "line", 1, "MIT"), (2, "line", 2, "MIT"), (3, "document", 0, "CC-BY-NC-4.0"),
                   (3, "line", 2, "CC-BY-NC-4.0"), (None, "document", 0, "MIT"), (None, "line", 1, "MIT"),
                   (8, "line", 1, "MIT"), (8, "line", 2, "MIT")}
    shuffled = scan_licenses(docs, known_licenses(spark), broadcast_licenses=0)
    assert {(r["doc_id"], r["unit"], r["line_no"], r["license"]) for r in shuffled.collect()} == got
    assert scan_licenses(empty(spark), known_licenses(spark)).count() == 0
    assert scan_licenses(docs, known_licenses(spark).where("false")).count() == 0
    long_text = "\n".join(["filler line"] * 20_000 + ["Released under the MIT License."])
    assert [r["line_no"] for r in scan_licenses(awkward(spark, [(1, long_text)]), known_licenses(spark)).collect()] == [20_001]


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


@pytest.mark.parametrize("license,titles,text", ENTIRE)
def test_entire_licenses(spark, license, titles, text):
    """A published file: title, copyright lines and wrapped text, at any width, in a comment block, with other spellings."""
    head, tail = "Copyright (c) 2015-2020, J. Q. Public and others", "All rights reserved."
    docs = [(i, f"{titles[0]}\n\n{head}\n{tail}\n\n{wrapped(text, width)}\n") for i, width in enumerate((30, 61, 72, 10_000))]
    docs += [(10, f"/*\n * {head}\n *\n{wrapped(text, 66, ' * ')}\n */"), (11, text.replace("copyright holder", "copyright owner").upper()),
             (12, f"prose before\n\n{wrapped(text, 50, '# ')}\n\nprose after"), (13, wrapped(text, 70)[:-30]), (14, f"{wrapped(text, 70)}\nand more")]
    got = scan_licenses(awkward(spark, docs), known_licenses(spark)).where(F.col("license") == license).collect()
    assert {r["doc_id"] for r in got if r["unit"] == "document"} == {0, 1, 2, 3, 10, 11}
    assert {(r["doc_id"], r["line_no"]) for r in got if r["unit"] == "paragraph" and r["doc_id"] in (0, 1, 2, 10, 12)} >= {(0, 6), (1, 6), (2, 6), (10, 4), (12, 3)}
    assert not {r["doc_id"] for r in got if r["unit"] != "line"} & {13, 14}


def test_copyright_statement_ends_with_its_sentence(spark):
    docs = [(1, "Copyright 2020 X. Released under the MIT License."), (2, "(c) 2019 Foo, Inc. All rights reserved. Licensed under CC BY 4.0."),
            (3, "# Copyright (C) 2020 J. Smith"), (4, "© Jones.\tThis work is licensed under the GNU General Public License, version 3."),
            (5, "copyright notice. Released under the MIT License."), (6, "Copyright 2020 X. Other words. released"),
            (7, "a\u2028Copyright 2020 X\u2028. Released under the MIT License."), (8, "Copyright 2020 X\u0085")]
    got = {(r["doc_id"], r["license"]) for r in scan_licenses(awkward(spark, docs), known_licenses(spark)).where("unit = 'line'").collect()}
    assert got == {(1, "MIT"), (2, "CC-BY-4.0"), (4, "GPL-3.0")}


def test_license_paragraphs_equal_sql(spark):
    """The query's SQL over made-up documents, as the tables hold no wrapped licence."""
    rng = random.Random(9)
    lines = ["", " ", " * ", "Released under the", "MIT License.", "Released under the MIT License.", "Copyright (c) 2020 A", "prose", "Licensed under CC BY 4.0."]
    rows = [(i, rng.choice(["\n", "\r\n", "\r"]).join(rng.choice(lines) for _ in range(rng.randrange(0, 12)))) for i in range(3000)]
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    con.register("documents", documents)
    want = con.execute(ORACLE_SQL["op10_license_scan"]).fetchall()
    got = [tuple(r) for r in scan_licenses(spark.createDataFrame(documents), known_licenses(spark)).collect()]
    assert sorted(got) == sorted(want) and {r[1] for r in got} == {"document", "paragraph", "line"}


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontaminate(spark, broadcast):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(500)]
    item = [rng.choice(words) for _ in range(24)]
    changed = list(item)
    for k in (4, 13, 20):
        changed[k] = "other"
    noise = [rng.choice(words) for _ in range(300)]
    rows = [(1, " ".join(noise[:50] + item + noise[50:90])), (2, " ".join(noise[:20] + changed)), (3, " ".join(noise)),
            (4, " ".join(noise[:30] + item[:9] + noise[30:60])), (5, None), (6, ""), (None, " ".join(item).upper()),
            (7, ", ".join(w + "!!" for w in item)), (8, " ".join(noise * 60 + item)), (8, " ".join(item))]
    benchmark = spark.createDataFrame([(10, " ".join(item), 1), (11, "too short", 2), (12, None, 3)], "item_id long, text string, doc_id long")
    limit = {} if broadcast else {"max_broadcast_chars": 0}
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate(awkward(spark, rows), benchmark, **limit).collect()}
    assert set(got) == {(1, 10), (2, 10), (None, 10), (7, 10), (8, 10)}
    assert got[1, 10]["first_word"] == 50 and got[1, 10]["n_equal"] == 24
    assert decontaminate(empty(spark), benchmark, **limit).count() == 0
    # 13 words from inside a long item are a quotation, 12 are not
    quoted = awkward(spark, [(1, " ".join(noise[:9] + item[6:19] + noise[9:30])), (2, " ".join(noise[:9] + item[6:18] + noise[9:30]))])
    assert {(r["doc_id"], r["n_equal"]) for r in decontaminate(quoted, benchmark, **limit).collect()} == {(1, 13)}
    # rows of one id count their own hits: equal rows, different texts, null ids
    again = awkward(spark, [(1, " ".join(item)), (1, " ".join(item)), (1, " ".join(noise)), (2, " ".join(item)), (None, " ".join(item)), (None, " ".join(noise[:4] + item))])
    hits = {r["doc_id"]: r["n_hits"] for r in decontaminate(again, benchmark, **limit).collect()}
    assert hits[1] == 2 * hits[2] == hits[None] == 2 * 3 * 16
    assert decontaminate(awkward(spark), benchmark.where("false"), **limit).count() == 0
