import json
import threading
import urllib.error
import urllib.request

import pytest

from lexigraph.__main__ import main
from lexigraph.library import Library
from lexigraph.operators import ingest
from lexigraph.server import make_server, respond
from lexigraph.sources import files
from lexigraph.sources.collect import Collector, Refused, collect
from lexigraph.streaming.arrivals import index_stream

BOOK = "id long, title string, author string, source string, text string"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    made = Library(spark, f"file://{tmp_path_factory.mktemp('served')}")
    made.import_books(spark.createDataFrame([(1, "<script>title</script>", "A", "s", "ocean ocean sea")], BOOK), min_words=1)
    return made


def test_http(library):
    server = make_server(library, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path):
        try:
            with urllib.request.urlopen(base + path) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert get("/api/stats")[1]["books"] == 1
    status, found = get("/api/search?q=ocean")
    assert status == 200 and found["results"][0]["occurrences"] == 2 and found["results"][0]["title"] == "<script>title</script>"
    assert get("/api/search?q=(&mode=regex")[0] == 400 and get("/api/search?q=sea&page=no")[0] == 400
    assert get("/etc/passwd")[0] == 404
    server.shutdown()


def test_busy(library, spark, tmp_path):
    slots = threading.BoundedSemaphore(1)
    slots.acquire()
    assert respond(library, "/api/search?q=ocean", slots)[0] == 503
    assert respond(library, "/api/stats", slots)[0] == 200  # takes no search slot
    slots.release()
    broken = Library(spark, f"file://{tmp_path}")
    broken.store.point({"books": ["books/gone"], "terms": ["terms/gone"], "postings": ["postings/gone"]})
    assert respond(broken, "/api/stats", slots)[0] == respond(broken, "/api/search?q=x", slots)[0] == 503
    assert slots.acquire(blocking=False)  # was given back


def test_command_line(spark, tmp_path, capsys):
    books = tmp_path / "books"
    books.mkdir()
    for i, text in ((1, "sea ocean " * 5000), (2, "forest tree\r\n" * 5000)):
        (books / f"{i}.txt").write_text(text, newline="")
        (books / f"{i}.json").write_text(json.dumps(dict(id=i, title=f"T{i}", author="A", source="s", words=1, digest="old")))
    run = lambda *a: main(["--library", f"file://{tmp_path}/library", *a], spark)
    assert run("index", str(books)) == 0 and "Imported 2" in capsys.readouterr().out
    assert run("index", str(books)) == 0 and "Imported 0" in capsys.readouterr().out
    assert run("graph", "--threshold", "0.5") == 0
    assert run("graph", "--threshold", "2") == 1
    assert run("search", "ocean") == 0 and '"total": 1' in capsys.readouterr().out
    assert run("validate") == 1  # too few books for a full corpus


def test_catalog(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text('Text#,Title,Authors,Language,Type\n5,"A, ""b""\nc",,en,Text\n11,Alice,Carroll, en ,Text\n6,X,Y,fr,Text\n7,X,Y,en,Sound\n', encoding="utf-8-sig")
    catalog = files.read_catalog(spark, str(path))
    rows = ingest.catalog_candidates(catalog).orderBy(*ingest.catalog_order(catalog))
    found = files.catalog_books(rows).collect()
    assert [(r["id"], r["title"], r["author"]) for r in found] == [(11, "Alice", "Carroll"), (5, 'A, "b"\nc', "Unknown")]
    path.write_text("Text#,Title\n1,x\n")
    with pytest.raises(ValueError):
        files.read_catalog(spark, str(path))


def test_statuses(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "a"), (4, "<html> a b c"), (5, "d e f"), (6, None), (7, "a")], "id long, text string")
    known = rows.filter("id = 5")
    known = ingest.cleaned(known).select("digest")
    found = {r["id"]: r["status"] for r in ingest.statuses(rows, 2, known).collect()}
    assert found == {1: "accepted", 2: "duplicate", 3: "short", 4: "error", 5: "duplicate", 6: "error", 7: "short"}
    states = spark.createDataFrame([(1, "short"), (2, "error")], "id long, status string")
    assert [r["id"] for r in ingest.unfinished(rows, states).orderBy("id").collect()] == [2, 3, 4, 5, 6, 7]


def test_fetch():
    class Answer:
        def __init__(self, data):
            self.data = data

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, n):
            return self.data[:n]

    assert files.fetch("http://x", opener=lambda u, timeout: Answer(b"abc")) == b"abc"
    with pytest.raises(ValueError):
        files.fetch("http://x", max_bytes=2, opener=lambda u, timeout: Answer(b"abc"))
    calls, waits = [], []

    def failing(code):
        def opener(request, timeout):
            calls.append((request.full_url, request.get_header("User-agent"), timeout))
            raise urllib.error.HTTPError(request.full_url, code, "", None, None)

        return opener

    with pytest.raises(urllib.error.HTTPError):
        files.fetch("http://x", opener=failing(404), pause=waits.append)
    assert len(calls) == 1
    with pytest.raises(urllib.error.HTTPError):
        files.fetch("http://x", opener=failing(500), pause=waits.append)
    assert len(calls) == 4 and waits == [2.0, 4.0] and set(calls) == {("http://x", files.AGENT, 45)}

    def slow(request, timeout):
        waits.append("late")
        raise TimeoutError

    with pytest.raises(TimeoutError):
        files.fetch("http://x", opener=slow, pause=lambda s: None)
    assert waits.count("late") == 3


def test_collect(spark, tmp_path):
    texts = {11: "sea ocean whale", 12: "sea ocean whale", 13: "short", 14: None, 15: "<html> a b c", 16: "new words here"}
    rows = [(i, f"T{i}", "A", "s", f"u{i}", "en") for i in texts]
    candidates = spark.createDataFrame(rows, "id long, title string, author string, source string, download_url string, language string")

    def get(url):
        text = texts[int(url[1:])]
        if text is None:
            raise urllib.error.HTTPError(url, 404, "", None, None)
        return text.encode()

    def collector(folder, get=get, words=2):
        return Collector(spark, f"{tmp_path}/{folder}", words, get=get, pause=lambda s: None)

    state = lambda: {int(k): v["status"] for k, v in json.loads((tmp_path / "one/collection.json").read_text()).items()}
    # Lost in the middle of the fourth book: what was reached is on disk.
    lost = lambda url: get(url) if url != "u14" else (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        collector("one", lost).run(candidates, 10)
    assert state() == {11: "accepted", 12: "duplicate", 13: "short"}
    asked = []
    assert collector("one", lambda url: asked.append(url) or get(url)).run(candidates, 10) == 2
    assert asked == ["u14", "u15", "u16"]  # no book twice
    assert state() == {11: "accepted", 12: "duplicate", 13: "short", 14: "missing", 15: "error", 16: "accepted"}
    texts[15] = "now a text"
    assert collector("one").run(candidates, 10) == 3 and state()[15] == "accepted"
    assert collector("two").run(candidates, 10, seed=True) == 1
    saved = tmp_path / "one/books/16.txt"
    saved.write_text("new words\r\r\nhere", newline="")
    assert collector("one").resume() == 3 and saved.read_bytes() == b"new words\nhere"
    assert json.loads((tmp_path / "one/books/16.json").read_text())["words"] == 3
    assert files.read_books(spark, f"file://{tmp_path}/one/books").count() == 3

    def down(url):
        raise OSError("down")

    with pytest.raises(ValueError):
        collector("three", down).run(candidates, 10)
    assert len(json.loads((tmp_path / "three/collection.json").read_text())) == 5
    with pytest.raises(ValueError):
        collector("one", words=100).resume()
    refuse = lambda url: (_ for _ in ()).throw(urllib.error.HTTPError(url, 403, "", None, None))
    with pytest.raises(Refused):
        collector("four", refuse).run(candidates, 10)
    saved.unlink()
    with pytest.raises(ValueError):
        collector("one").resume()


def test_collect_and_prepare_commands(spark, tmp_path, monkeypatch, capsys):
    text = {i: " ".join(f"word{chr(97 + (i * k) % 23)}{chr(97 + k % 19)}" for k in range(10_050)) for i in (11, 74, 500)}

    def get(url, max_bytes=0, **_):
        if url == files.CATALOG:
            return b'Text#,Title,Authors,Language,Type\n74,B,,en,Text\n11,A,Z,en,Text\n500,C,Y,en,Text\n9,D,Y,fr,Text\n'
        number = int(url.split("/")[-2])
        assert url == f"{files.MIRROR}/{number}/pg{number}.txt"
        return text[number].encode()

    monkeypatch.setattr("lexigraph.__main__.collect", lambda *a: collect(*a, get=get, pause=lambda s: None))
    run = lambda *a: main(["--library", f"file://{tmp_path}/library", *a], spark)
    assert run("collect", "--data", f"{tmp_path}/data", "--target", "2") == 0
    assert sorted(p.name for p in (tmp_path / "data/books").glob("*.txt")) == ["11.txt", "74.txt"]
    assert json.loads((tmp_path / "data/books/74.json").read_text())["author"] == "Unknown"
    assert run("collect", "--data", f"{tmp_path}/data", "--seed") == 1  # ten of the twelve aren't listed
    assert run("collect", "--data", f"{tmp_path}/data", "--target", "0") == 1
    capsys.readouterr()
    assert run("prepare", "--data", f"{tmp_path}/data", "--target", "3") == 0
    said = capsys.readouterr().out
    stages = json.loads(said[said.index("{") :])
    assert stages["index"]["result"] == 3 and stages["graph"]["result"]["nodes"] == 3 and stages["validate"]["result"]["checks"]["graph_ready"]


def test_stream(spark, tmp_path):
    arrivals = tmp_path / "in"
    rows = spark.createDataFrame([(1, "a", "b", "c", "sea ocean"), (2, "a", "b", "c", "sea ocean"), (3, "a", "b", "c", "tree")], BOOK)
    rows.write.parquet(str(arrivals))
    library = Library(spark, f"file://{tmp_path}/library")
    for _ in range(2):
        index_stream(spark.readStream.schema(BOOK).parquet(str(arrivals)), library, f"{tmp_path}/checkpoint").awaitTermination()
    assert library.stats()["books"] == 2


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "name string, n double")
    files.write_csv(rows, f"{tmp_path}/csv")
    files.write_json(rows, f"{tmp_path}/json")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == spark.read.json(f"{tmp_path}/json").count() == 2
    assert {r["label"]: r["share"] for r in files.bars(rows, "name", "n").collect()} == {"a": 0.5, "b": 1.0}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
