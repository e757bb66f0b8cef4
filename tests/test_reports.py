import csv
import json
import xml.etree.ElementTree as ET

import pytest

from lexigraph import benchmarks
from lexigraph.__main__ import main
from lexigraph.library import Library
from lexigraph.sources import reports

BOOK = "id long, title string, author string, source string, text string"
ASKED = [("keyword", "heron"), ("regex", "he.*|reed")]


def books(spark, n, repeated=False):
    texts = [f"heron reed pond w{'' if repeated else i} " * (i % 3 + 1 if not repeated else 1) for i in range(n)]
    return spark.createDataFrame([(i, f"T{i}", "A", "s", t) for i, t in enumerate(texts)], BOOK)


def test_bar_chart(spark):
    rows = spark.createDataFrame([("b<&", 4.0), ("a", 2.0), ("c", None), ("d", -1.0)], "name string, n double")
    drawn = ET.fromstring(reports.bar_chart(rows, "name", "n", "Size & <more>", "s"))
    widths = [float(e.get("width")) for e in drawn.iter() if e.tag.endswith("rect")]
    texts = [e.text for e in drawn.iter() if e.tag.endswith("text")]
    assert widths[1] > 0 and widths == [widths[1] / 2, widths[1], 0, 0]
    assert texts == ["Size & <more>", "a", "2 s", "b<&", "4 s", "c", "-", "d", "-1 s"]
    assert ET.fromstring(reports.bar_chart(rows.limit(0), "name", "n", "none")) is not None


def test_html_table(spark):
    rows = spark.createDataFrame([("<script>", None), ('"q"&', 2)], "name string, n long")
    table = ET.fromstring(reports.html_table(rows, "<c>"))
    assert [c.text for c in table.iter("td")] == ["<script>", None, '"q"&', "2"]
    assert [c.text for c in table.iter("th")] == ["name", "n"] and table.find("caption").text == "<c>"
    assert "<script>" not in reports.html_page("<script>", reports.html_table(rows))
    with pytest.raises(ValueError):
        reports.html_table(rows, limit=1)


def test_growth(spark, tmp_path):
    scaling, samples = benchmarks.growth(books(spark, 6), f"file://{tmp_path}", [4, 2, 4], ASKED, repeats=2, min_words=1)
    found = scaling.orderBy("books").collect()
    assert [r["books"] for r in found] == [2, 4] and all(r["index_seconds"] > 0 and r["stored_bytes"] > 0 for r in found)
    assert [r["edges"] for r in found] == [Library(spark, next(f"file://{p}" for p in tmp_path.glob(f"library-{n}-*"))).tables()["edges"].count() for n in (2, 4)]
    assert sorted((r["books"], r["mode"], r["iteration"], r["results"]) for r in samples.collect()) == [(n, m, i, n) for n in (2, 4) for m in ("keyword", "regex") for i in (1, 2)]
    written = [line for p in tmp_path.glob("query_samples/*.csv") for line in csv.DictReader(p.open())]
    assert len(written) == 8 and ET.parse(tmp_path / "index_seconds.svg")


def test_growth_refuses_wrong_numbers(spark, tmp_path):
    for rows, sizes in ((books(spark, 3), [4]), (books(spark, 3, repeated=True), [2]), (books(spark, 3), [0])):
        with pytest.raises(ValueError):
            benchmarks.growth(rows, f"file://{tmp_path}", sizes, ASKED, 1, min_words=1)


def test_load(spark, tmp_path, capsys):
    library = Library(spark, f"file://{tmp_path}/library")
    library.import_books(books(spark, 3), min_words=1)
    samples, summary = benchmarks.load(library, [3, 1], 6, ASKED)
    found = {r["clients"]: r for r in summary.collect()}
    assert found[1]["successes"] == 6 and found[3]["requests"] == 6 == found[3]["successes"] + found[3]["rejected_503"]
    assert found[1]["success_p95_ms"] >= found[1]["success_median_ms"] > 0
    one = samples.filter("clients = 1").orderBy("request").collect()
    assert [(r["mode"], r["query"]) for r in one] == ASKED * 3 and all(r["results"] == 3 for r in one)
    with pytest.raises(RuntimeError):
        benchmarks.load(library, [1], 1, [("regex", "(")])
    run = lambda *a: main(["--library", f"file://{tmp_path}/library", "load", f"file://{tmp_path}/out", *a], spark)
    assert run("--clients", "1", "--requests", "2", "--query", "keyword:heron") == 0
    assert json.loads(capsys.readouterr().out)[0]["requests"] == 2 and "<svg" in (tmp_path / "out/report.html").read_text()
    assert run("--query", "heron") == 1
