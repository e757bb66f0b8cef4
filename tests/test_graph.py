import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.operators import graph


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def links(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, similarity double")


def solved(ids, pairs, damping=0.85):
    """PageRank as the solution of its linear equations."""
    ids, n = sorted(ids), len(ids)
    place = {v: i for i, v in enumerate(ids)}
    flow = np.zeros((n, n))
    for a, b in pairs:
        flow[place[a], place[b]] = flow[place[b], place[a]] = 1
    degree = flow.sum(axis=0)
    flow = np.where(degree > 0, flow / np.maximum(degree, 1), 1 / n)
    rank = np.linalg.solve(np.eye(n) - damping * flow, np.full(n, (1 - damping) / n))
    return dict(zip(ids, rank))


SHAPES = {
    "wheel": ([1, 2, 3, 4, 5, 6], [(1, i) for i in range(2, 7)] + [(2, 3), (3, 4), (4, 5), (5, 6), (2, 6)]),
    "two paths and strays": ([10, 20, 30, 40, 50, 60, 70], [(10, 20), (20, 30), (40, 50)]),
    "strays only": ([3, 5, 8], []),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("by", [graph.pagerank, graph.pagerank_by_join])
def test_pagerank_solves_its_equations(spark, shape, by):
    ids, pairs = SHAPES[shape]
    tolerance = 1e-10 if by is graph.pagerank else 1e-5
    found, _ = by(nodes(spark, ids), links(spark, pairs), tolerance=tolerance)
    found = {r["book_id"]: r["score"] for r in found.collect()}
    assert found == pytest.approx(solved(ids, pairs), abs=10 * tolerance) and sum(found.values()) == pytest.approx(1)


def test_pagerank_of_nothing_and_without_convergence(spark):
    found, turns = graph.pagerank(nodes(spark, []), links(spark, []))
    assert (found.collect(), turns) == ([], 0)
    for by in (graph.pagerank, graph.pagerank_by_join):
        with pytest.raises(graph.NotConverged):
            by(nodes(spark, [1, 2, 3, 4]), links(spark, [(1, 2), (2, 3), (3, 4)]), max_iterations=3)[0].collect()


def test_both_ways_of_pagerank_agree(spark):
    draw = np.random.default_rng(41)
    pairs = sorted({tuple(sorted(p)) for p in draw.integers(0, 120, (260, 2)).tolist() if p[0] != p[1]})
    ids = range(130)
    scores = [{r["book_id"]: r["score"] for r in by(nodes(spark, ids), links(spark, pairs), tolerance=1e-6)[0].collect()} for by in (graph.pagerank, graph.pagerank_by_join)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)
    assert scores[0] == pytest.approx(solved(ids, pairs), abs=1e-5)


@pytest.mark.parametrize("seed,books,words", [(5, 20, 15), (6, 41, 60)])
def test_tiles_and_join_equal_counting(spark, seed, books, words):
    """Zipf-like bags, some empty of common words, some with huge counts."""
    draw = np.random.default_rng(seed)
    bags = {}
    for i in range(books):
        chosen = draw.choice(words, draw.integers(1, words // 2), replace=False)
        bags[int(i * 37 + draw.integers(0, 30))] = {f"term{w}": int(min(draw.zipf(1.4), 10**6)) for w in chosen}
    bags[10**7] = {"alone": 4}
    index = spark.createDataFrame([(w, i, c) for i, bag in bags.items() for w, c in bag.items()], "word string, book_id long, count long")
    low, high, shared = collections.Counter(), collections.Counter(), collections.Counter()
    for a, x in bags.items():
        for b, y in bags.items():
            for w in x.keys() & y.keys() if a < b else ():
                low[a, b] += min(x[w], y[w])
                high[a, b] += max(x[w], y[w])
                shared[a, b] += 1
    expected = {k: (shared[k], low[k], high[k]) for k in shared}
    told = lambda pairs: {(r["a"], r["b"]): (r["shared_words"], r["minimum"], r["maximum"]) for r in pairs.collect()}
    for blocks in (1, 3, 7):
        assert told(graph.overlaps(index, blocks=blocks)) == expected
    assert told(graph.overlaps_by_join(index)) == expected
    for level in (0.0, 0.2, 0.5):
        assert {(r["a"], r["b"]): r["similarity"] for r in graph.edges(index, level).collect()} == pytest.approx({k: low[k] / high[k] for k in shared if low[k] / high[k] > level})


def test_connectivity_and_decomposition(spark):
    pairs = spark.createDataFrame([(1, 2, 0.6), (2, 3, 0.9), (4, 5, 0.7)], "a long, b long, similarity double")
    all_nodes = nodes(spark, range(1, 7))
    out = {r["threshold"]: r for r in graph.connectivity(all_nodes, pairs, (0.8, 0.5, 0.65)).collect()}
    assert [(out[t]["edges"], out[t]["components"], out[t]["largest_component"], out[t]["isolated"]) for t in (0.5, 0.65, 0.8)] == [(3, 3, 3, 1), (2, 4, 2, 2), (1, 5, 2, 4)]
    assert out[0.5]["density"] == pytest.approx(0.2) and out[0.5]["mean_degree"] == pytest.approx(1.0)
    scores, _ = graph.pagerank(all_nodes, pairs)
    assert all(r["residual"] < 1e-9 for r in graph.decomposition(all_nodes, pairs, scores).collect())
    top = graph.top_contributions(graph.contributions(all_nodes, pairs, scores), 1).filter("id = 2").collect()
    assert len(top) == 1 and top[0]["neighbour"] == 1


def test_connectivity_below_the_stored_threshold_is_computed_anew(spark):
    index = spark.createDataFrame([("a", 1, 1), ("a", 2, 4), ("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "word string, book_id long, count long")
    stored = graph.edges(index, 0.4)
    out = {r["threshold"]: r["edges"] for r in graph.connectivity(nodes(spark, [1, 2, 3, 4]), stored, (0.1, 0.4), stored=0.4, index=index).collect()}
    assert out == {0.1: 2, 0.4: 1}
    with pytest.raises(ValueError):
        graph.connectivity(nodes(spark, [1, 2, 3, 4]), stored, (0.1,), stored=0.4)


def clustered(spark):
    """A large and a small crowd that share no word, pairs and a chain that reach one of them only at
    their ends, books alone, and the edges by counting."""
    draw = np.random.default_rng(77)
    bags = {i: {f"w{int(i % 5 == 0)}x{w}": int(draw.integers(1, 3)) for w in draw.choice(12, 6, replace=False)} for i in range(100, 180)}
    bags |= {1: {"p": 1}, 2: {"p": 1, "q": 9}, 3: {"q": 9, "r": 2}, 4: {"r": 2, "w0x0": 1}, 50: {"solo": 3}, 51: {"far": 1, "r": 40}, 60: {"m": 2}, 61: {"m": 2}}
    index = spark.createDataFrame([(w, i, c) for i, bag in bags.items() for w, c in bag.items()], "word string, book_id long, count long")
    met = {(a, b): [(x[w], y[w]) for w in x.keys() & y.keys()] for a, x in bags.items() for b, y in bags.items() if a < b}
    near = {k: sum(map(min, v)) / sum(map(max, v)) for k, v in met.items() if v}
    return [*bags, 999], index, {k: v for k, v in near.items() if v > 0.5}


@pytest.mark.parametrize("probes", [1, 4, 1000])
def test_components_and_isolated_books_without_all_edges(spark, monkeypatch, probes):
    ids, index, near = clustered(spark)
    if probes == 4:

        def refused(*_):
            raise AssertionError("All pairs were compared.")

        monkeypatch.setattr(graph, "overlaps", refused)
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["component"] for r in graph.joined_components(nodes(spark, ids), index, 0.5, probes).collect()} == label
    assert {r["id"] for r in graph.isolated(nodes(spark, ids), index, 0.5, probes).collect()} == set(ids) - {i for pair in near for i in pair}


def test_edges_of_some_books(spark):
    _, index, near = clustered(spark)
    own, others = {1, 3, 100, 101, 102}, {2, 4, 50, 100, 102, 130}
    told = lambda rows: {(r["a"], r["b"]): r["similarity"] for r in rows.collect()}
    assert told(graph.edges_between(index, nodes(spark, own))) == {k: v for k, v in near.items() if own & set(k)}
    assert told(graph.edges_between(index, nodes(spark, own), nodes(spark, others))) == {k: v for k, v in near.items() if k[0] in own and k[1] in others or k[1] in own and k[0] in others}


def test_recommendations_need_only_the_seeds_edges(spark):
    from lexigraph.operators import search

    _, index, near = clustered(spark)
    ids = sorted({r["book_id"] for r in index.select("book_id").collect()})
    books = spark.createDataFrame([(i, f"t{i}", "a", "s", 1) for i in ids], "id long, title string, author string, source string, words long")
    found = index.filter("word = 'w0x0'").select("book_id", F.col("count").alias("occurrences"), F.lit(0.0).alias("pagerank"))
    own = graph.edges_between(index, search.seeds(found, "frequency").select(F.col("book_id").alias("id")))
    told = lambda links: [tuple(r) for r in search.recommendations(found, links, books, "frequency").orderBy("place").collect()]
    assert own.count() < len(near) and told(own) == told(graph.edges(index)) != []


@pytest.mark.parametrize("probes", [1, 4, 128])
def test_isolated_books_without_a_join_of_postings(spark, monkeypatch, probes):
    """what few books are compared with is met where it is read."""
    ids, index, near = clustered(spark)

    def refused(*_):
        raise AssertionError("Postings were joined.")

    monkeypatch.setattr(graph, "edges_between", refused)
    monkeypatch.setattr(graph, "edges", refused)
    alone = set(ids) - {i for pair in near for i in pair}
    assert {r["id"] for r in graph.isolated(nodes(spark, ids), index, 0.5, probes).collect()} == alone
    assert {r["id"] for r in graph.isolated(nodes(spark, ids), None, 0.5, probes, graph.bags_of(index)).collect()} == alone


def test_isolated_books_that_are_many(spark, monkeypatch):
    """More than the driver may hold are compared in the plainer ways."""
    ids, index, near = clustered(spark)
    alone = set(ids) - {i for pair in near for i in pair}
    monkeypatch.setattr(graph, "MOST_PROBES", 0)
    assert {r["id"] for r in graph.isolated(nodes(spark, ids), None, 0.5, 4, graph.bags_of(index)).collect()} == alone


def test_edges_of_a_few_bags(spark, monkeypatch):
    """blocks of a few books, pairs of two of the asked books once, and only counts over 0."""
    from lexigraph.operators import tiles

    monkeypatch.setattr(tiles, "BLOCK", 7)
    _, index, near = clustered(spark)
    own = {1, 3, 50, *range(100, 120)}
    found = [tuple(r) for r in graph.edges_of(graph.bags_of(index), sorted(own)).collect()]
    assert len({f[:2] for f in found}) == len(found) and {f[:2]: f[2] for f in found} == {k: v for k, v in near.items() if own & set(k)}
    assert graph.edges_of(graph.bags_of(index), []).collect() == []


def test_bags_equal_the_postings(spark):
    """one row for each book, copies and repeated ids by the rules of an import."""
    from lexigraph.operators import ingest

    rows = [(1, "Sea sea\r\nocean"), (2, "sea sea ocean"), (3, "Sea sea\nocean"), (4, None), (4, "b b c"), (4, "a"), (5, " 12 "), (6, "sea Sea\r\rocean *** x"), (7, "b b c"), (8, "µ ß’s")]
    texts = spark.createDataFrame([(i, f"t{i}", text) for i, text in rows], "id long, title string, text string")
    stage = ingest.staged(texts)
    counts = ingest.word_counts(stage)
    books = ingest.accepted(stage, counts, 1)
    expected = books.join(counts, "turn").select("id", "word", "count", "words")
    found = ingest.first_copies(ingest.bagged(texts))
    told = graph.index_of(found.withColumnRenamed("id", "book_id")).join(found.select(F.col("id").alias("book_id"), "total"), "book_id").select("book_id", "word", "count", "total")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, expected.collect())) != []
