import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.library import Library
from lexigraph.operators import graph, ingest
from lexigraph.operators.ingest import ShortBook
from lexigraph.plans.storage import Store

#: A small kitchen library. Word counts differ, so that ranks, overlaps and
#: frequencies all do; the last two share nothing with the rest.
SHELF = {
    10: "bread flour water salt bread yeast oven bread",
    20: "bread butter salt oven flour",
    30: "soup water salt onion carrot soup",
    40: "onion carrot leek soup water oven stove",
    50: "butter flour sugar egg oven butter",
    60: "violin bow string",
    70: "zürich élan naïve",
}
BOOK = "id long, title string, author string, source string, text string"
LEVEL = 0.75


def rows(spark, texts):
    return spark.createDataFrame([(i, f"Book {i}", "Cook", "shelf", t) for i, t in texts.items()], BOOK)


def bags(texts):
    return {i: collections.Counter(t.split()) for i, t in texts.items()}


def brute_edges(texts, level):
    """Edges above the level from all pairs of bags."""
    out = {}
    for (a, x), (b, y) in itertools.combinations(sorted(bags(texts).items()), 2):
        both = x.keys() & y.keys()
        top = sum(max(x[w], y[w]) for w in both)
        if both and sum(min(x[w], y[w]) for w in both) / top > level:
            out[a, b] = sum(min(x[w], y[w]) for w in both) / top
    return out


def brute_ranks(texts, edges, damping=0.85):
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in texts}
    rank = {i: 1 / len(texts) for i in texts}
    for _ in range(300):
        lost = sum(rank[i] for i in texts if not near[i])
        rank = {i: (1 - damping + damping * lost) / len(texts) + damping * sum(rank[j] / len(near[j]) for j in near[i]) for i in texts}
    return rank


EDGES = brute_edges(SHELF, LEVEL)
RANKS = brute_ranks(SHELF, EDGES)


def brute_search(pattern, ranking):
    """(id, occurrences) in order."""
    counts = {i: sum(bool(re.fullmatch(pattern, w)) for w in t.split()) for i, t in SHELF.items()}
    key = (lambda i: (-RANKS[i], -counts[i], i)) if ranking == "pagerank" else (lambda i: (-counts[i], -RANKS[i], i))
    return [(i, counts[i]) for i in sorted((i for i in counts if counts[i]), key=key)]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    made = Library(spark, f"file://{tmp_path_factory.mktemp('library')}")
    assert made.import_books(rows(spark, SHELF), min_words=1) == len(SHELF)
    made.build_graph(LEVEL)
    return made


def test_the_fixture_says_something():
    assert 3 <= len(EDGES) < 10 and len({round(r, 9) for r in RANKS.values()}) >= 4


def test_edges_and_ranks(library):
    found = {(r["a"], r["b"]): r["similarity"] for r in library.tables()["edges"].collect()}
    assert found == pytest.approx(EDGES)
    assert {r["book_id"]: r["score"] for r in library.tables()["scores"].collect()} == pytest.approx(RANKS, abs=1e-8)


@pytest.mark.parametrize("ranking", ["pagerank", "frequency"])
@pytest.mark.parametrize("word", ["bread", "SALT", "oven", "Soup", "violin"])
def test_keywords(library, word, ranking):
    out = library.search(word, ranking=ranking)
    assert [(r["id"], r["occurrences"]) for r in out["results"]] == brute_search(word.lower(), ranking)
    assert out["matched_terms"] == [word.lower()] and out["matched_term_count"] == 1 and out["graph_ready"]
    for r in out["results"]:
        assert r["pagerank"] == pytest.approx(RANKS[r["id"]], abs=1e-8) and r["title"] == f"Book {r['id']}"


@pytest.mark.parametrize("pattern", ["bread|soup", "(b|s).*", "so?up", "[^bs].*", "[a-f]+", ".*", "on(ion)+", "x?(egg|leek)"])
def test_patterns_equal_a_scan(library, pattern):
    for ranking in ("frequency", "pagerank"):
        out = library.search(pattern, mode="regex", ranking=ranking)
        assert [(r["id"], r["occurrences"]) for r in out["results"]] == brute_search(pattern, ranking)
    words = sorted({w for t in SHELF.values() for w in t.split() if re.fullmatch(pattern, w)})
    assert out["matched_terms"] == words[:30] and out["matched_term_count"] == len(words)


def test_many_matched_words_are_joined(library, monkeypatch):
    monkeypatch.setattr("lexigraph.operators.search.NAMED_TERMS", 3)
    monkeypatch.setattr("lexigraph.operators.search.SHOWN_TERMS", 2)
    for pattern in ("[a-f].*", "bread|soup"):
        out = library.search(pattern, mode="regex", ranking="frequency")
        assert [(r["id"], r["occurrences"]) for r in out["results"]] == brute_search(pattern, "frequency")
        words = sorted({w for t in SHELF.values() for w in t.split() if re.fullmatch(pattern, w)})
        assert out["matched_terms"] == words[:2] and out["matched_term_count"] == len(words)


def test_recommendations(library):
    for word in ("bread", "onion", "violin"):
        out = library.search(word, ranking="frequency")
        hits = [i for i, _ in brute_search(word, "frequency")]
        best = {}
        for place, seed in enumerate(hits[:3]):
            for (a, b), s in EDGES.items():
                other = b if a == seed else a if b == seed else None
                if other is not None and other not in hits and (other not in best or s > best[other][0]):
                    best[other] = (s, seed)
        expected = sorted(((-round(s, 6), i, seed) for i, (s, seed) in best.items()))[:6]
        assert [(-r["similarity"], r["id"], r["related_to"]) for r in out["recommendations"]] == expected


def test_pages(library):
    whole = brute_search("oven", "pagerank")
    pages = [library.search("oven", page=p, page_size=2) for p in (1, 2, 3)]
    assert [(r["id"], r["occurrences"]) for p in pages for r in p["results"]] == whole
    assert {p["total"] for p in pages} == {len(whole)} and pages[2]["results"] == []
    assert pages[0]["recommendations"] == pages[1]["recommendations"]


def test_nothing_found(library):
    for asked in (dict(query="pepper"), dict(query="()", mode="regex"), dict(query="q.*", mode="regex")):
        out = library.search(**asked)
        assert (out["total"], out["results"], out["recommendations"], out["matched_terms"], out["matched_term_count"]) == (0, [], [], [], 0)


@pytest.mark.parametrize("asked", [dict(query="\t"), dict(query="bread salt"), dict(query="42"), dict(query="salt", mode="fuzzy"), dict(query="salt", page=0), dict(query="salt", page_size=51), dict(query="salt", ranking="random"), dict(query="[", mode="regex"), dict(query="y" * 129)])
def test_bad_queries(library, asked):
    with pytest.raises(ValueError):
        library.search(**asked)


def test_a_slow_search_is_refused(library):
    with pytest.raises(ValueError):
        library.search("bread", budget=0.0)


def test_checks(library):
    found = library.validate()
    assert found["stats"]["books"] == len(SHELF) and found["stats"]["terms"] == len({w for t in SHELF.values() for w in t.split()})
    assert [k for k, v in found["checks"].items() if not v] == ["corpus_minimum"]
    assert found["stats"]["graph"]["metric"] == "lecture3-weighted-shared"


def test_subset(library, tmp_path):
    part = library.subset(f"file://{tmp_path}", 4)
    first = {i: SHELF[i] for i in sorted(SHELF)[:4]}
    assert {r["id"] for r in part.tables()["books"].collect()} == set(first)
    assert part.tables()["edges"].count() == len([e for e in EDGES if set(e) <= set(first)])
    assert part.tables()["terms"].count() == len({w for t in first.values() for w in t.split()})


@pytest.fixture
def fresh(spark, tmp_path):
    made = Library(spark, f"file://{tmp_path}")
    made.import_books(rows(spark, SHELF), min_words=1)
    made.build_graph(LEVEL)
    return made


def test_what_is_not_imported(spark, fresh):
    before = fresh.store.pointer()
    assert fresh.import_books(rows(spark, {80: SHELF[60], 10: "other words"}), min_words=1) == 0
    with pytest.raises(ShortBook):
        fresh.import_books(rows(spark, {80: "pan"}))
    with pytest.raises(ValueError):
        fresh.import_books(rows(spark, {80: "salt pepper thyme sage dill", 81: "cup of"}), min_words=3)
    assert fresh.store.pointer() == before and fresh.graph_info() is not None
    assert fresh.import_books(rows(spark, {80: "salt pepper thyme sage dill", 81: "cup of"}), min_words=3, strict=False) == 1


def test_rows_of_one_id_or_one_text_count_once(spark, tmp_path):
    made = Library(spark, f"file://{tmp_path}")
    table = spark.createDataFrame([(1, "t", "a", "s", "ham ham egg"), (1, "t", "a", "s", "ham ham egg"), (1, "t", "a", "s", "jam"), (2, "t", "a", "s", "jam"), (3, "t", "a", "s", "ham ham egg"), (4, "t", "a", "s", None)], BOOK)
    made.import_books(table, min_words=1, strict=False)
    books = {r["id"]: r["words"] for r in made.tables()["books"].collect()}
    assert set(books) <= {1, 2, 3} and sorted(books.values()) in ([1, 3], [1, 3, 3][:2])
    assert made.tables()["postings"].agg(F.sum("count")).first()[0] == sum(books.values())


def test_imports_append_and_make_the_graph_absent(spark, fresh):
    parts = fresh.store.pointer()["postings"]
    assert fresh.import_books(rows(spark, {80: "crème brûlée sugar sugar"}), min_words=1) == 1
    at = fresh.store.pointer()
    assert at["postings"][:-1] == parts and len(at["books"]) == len(at["terms"]) == 2
    assert fresh.graph_info() is None and fresh.tables()["scores"].count() == 0
    out = fresh.search("(cr|su).*", mode="regex", ranking="frequency")
    assert (out["results"][0]["id"], out["results"][0]["occurrences"], out["graph_ready"]) == (80, 3, False)
    assert fresh.tables()["terms"].count() == fresh.tables()["terms"].distinct().count()
    fresh.build_graph(LEVEL)
    before = {n: sorted(map(tuple, df.collect())) for n, df in fresh.tables().items()}
    fresh.compact()
    assert all(len(v) == 1 for k, v in fresh.store.pointer().items() if k in before)
    assert {n: sorted(map(tuple, df.collect())) for n, df in fresh.tables().items()} == before
    assert fresh.graph_info() is not None


def test_many_imports_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lexigraph.library.PARTS", 2)
    made = Library(spark, f"file://{tmp_path}")
    for i, text in SHELF.items():
        assert made.import_books(rows(spark, {i: text}), min_words=1) == 1
    assert len(made.store.pointer()["postings"]) <= 2
    whole = {(i, w): n for i, bag in bags(SHELF).items() for w, n in bag.items()}
    assert {(r["book_id"], r["word"]): r["count"] for r in made.tables()["postings"].collect()} == whole


def test_a_crash_at_any_moment_leaves_the_last_library(spark, fresh, tmp_path, monkeypatch):
    at = fresh.store.pointer()
    # A writer that is lost while it writes its pointer.
    (tmp_path / "pointers" / "000000000099.json").write_text('{"books": ["book')
    assert Store(spark, f"file://{tmp_path}").pointer() == at and fresh.stats()["books"] == len(SHELF)
    # One that is lost before it.
    monkeypatch.setattr(Store, "point", lambda self, to: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        fresh.import_books(rows(spark, {80: "salt pepper"}), min_words=1)
    monkeypatch.undo()
    assert fresh.store.pointer() == at and fresh.graph_info() is not None
    # The next one goes on above the broken number; two can't take the same.
    assert fresh.import_books(rows(spark, {80: "salt pepper"}), min_words=1) == 1
    assert fresh.stats()["books"] == len(SHELF) + 1
    numbers = Store._numbers
    monkeypatch.setattr(Store, "_numbers", lambda self: numbers(self)[1:])  # as if another had been faster
    with pytest.raises(Exception, match="exist"):
        fresh.store.point(at)


def test_checks_see_missing_scores_and_wrong_counts(spark, fresh):
    at = fresh.store.pointer()
    scores = fresh.tables()["scores"].filter("book_id != 40")
    total = scores.agg(F.sum("score")).first()[0]
    fresh.store.point(at | {"scores": [fresh.store.write(scores.withColumn("score", F.col("score") / total), "scores")]})
    found = fresh.validate()["checks"]
    assert found["pagerank_normalized"] and not found["pagerank_coverage"]
    posts = fresh.tables()["postings"]
    version = fresh.store.write(posts.withColumn("count", F.col("count") + (F.col("book_id") == 10).cast("long")), "postings")
    fresh.store.point(at | {"postings": [version], "graph_of": [version]})
    found = fresh.validate()["checks"]
    assert not found["index_counts"] and found["graph_counts"]


def test_refreshed_digests_and_repeat_imports(spark, fresh):
    at = fresh.store.pointer()
    assert fresh.index_books(rows(spark, SHELF), min_words=1) == 0 and fresh.store.pointer() == at
    changed = rows(spark, {10: SHELF[10] + " crumbs"})
    assert fresh.index_books(changed, min_words=1) == 0
    expected = changed.select(T.digest(T.clean_text(F.col("text")))).first()[0]
    assert fresh.tables()["books"].filter("id = 10").first()["digest"] == expected
    assert fresh.graph_info() is not None


def test_statuses_keep_the_first_of_each_text(spark):
    texts = spark.createDataFrame([(i, "hot words of one text") for i in range(200)] + [(500, "another one of them")], "id long, text string")
    found = {r["id"]: r["status"] for r in ingest.statuses(texts, 2).collect()}
    assert [i for i, s in found.items() if s == "accepted"] in ([0, 500], [500, 0]) and set(found.values()) == {"accepted", "duplicate"}


def test_strict_threshold(spark):
    index = spark.createDataFrame([("rye", 1, 3), ("oat", 1, 1), ("rye", 2, 1), ("nut", 2, 4)], "word string, book_id long, count long")
    found = lambda t: [tuple(r) for r in graph.edges(index, t).collect()]
    assert found(1 / 3) == [] and found(0.33) == [(1, 2, 1 / 3)] and found(0.0) == [(1, 2, 1 / 3)]
    for bad in (-0.01, 1.0):
        with pytest.raises(ValueError):
            graph.edges(index, bad)
