import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.operators import graph, tiles
from test_graph import clustered, nodes, solved

LEVELS = (0.5, 0.65, 0.9)


def cell(block, bags):
    """A block of the given books' bags of {word: count}."""
    rows = sorted((w, i, c) for i, bag in enumerate(bags) for w, c in bag.items())
    data = b"".join(np.array([r[k] for r in rows], t).tobytes() for k, t in enumerate((np.int32, np.int32, np.int64)))
    return tiles.Cell(block, np.arange(len(bags)), data)


@pytest.mark.parametrize("full,steps,huge", [(0.0, 1000, 1), (0.05, 64, 1), (1.0, 64, 1), (0.0, 2, 1), (0.0, 2, 10**7), (1.0, 64, 10**7)])
def test_sums_equal_counting(monkeypatch, full, steps, huge):
    """By columns only, by both and by meetings only; counts beyond float32 too."""
    monkeypatch.setattr(tiles, "FULL", full)
    monkeypatch.setattr(tiles, "FULL_LEVEL", full)
    monkeypatch.setattr(tiles, "MEETINGS", 50)
    monkeypatch.setattr(tiles, "STEPS", steps)
    draw = np.random.default_rng(5)
    one, two = ([{int(w): int(min(draw.zipf(1.5), 900)) * huge for w in draw.choice(40, draw.integers(0, 30), replace=False)} for _ in range(n)] for n in (23, 31))
    least, most, number = tiles.sums(cell(0, one), cell(1, two), True)
    for i, x in enumerate(one):
        for j, y in enumerate(two):
            both = x.keys() & y.keys()
            assert (least[i, j], most[i, j], number[i, j]) == (sum(min(x[w], y[w]) for w in both), sum(max(x[w], y[w]) for w in both), len(both))


def told(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows.collect())


@pytest.mark.parametrize("size", [40])
def test_graph_questions_without_edges(spark, size):
    """Degrees, connectivity, PageRank and top neighbours from the postings, in blocks of any size."""
    ids, index, near = clustered(spark)
    p, all_nodes = tiles.packed(index, size), nodes(spark, ids)
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in near.items()], "a long, b long, similarity double")
    assert told(tiles.over(p, lambda: tiles.Pairs(0.5, False)), "a", "b", "similarity") == told(edges, "a", "b", "similarity")
    assert told(tiles.degrees(p, (0.5,)), "id", "degree") == told(graph.degrees(all_nodes, edges).filter("degree > 0"), "id", "degree")
    columns = ("threshold", "edges", "density", "mean_degree", "isolated", "components", "largest_component")
    assert told(graph.connectivity_of(all_nodes, p, LEVELS), *columns) == told(graph.connectivity(all_nodes, edges, LEVELS), *columns)
    matrix = tiles.Matrix(p, tiles.bits(p, 0.5))
    score, degree, base = tiles.pagerank(matrix, len(ids))
    scores = dict.fromkeys(ids, base) | {r["book_id"]: r["score"] for r in matrix.table(score=score).collect()}
    assert scores == pytest.approx(solved(ids, list(near)), abs=1e-10)
    known = spark.createDataFrame(list(scores.items()), "book_id long, score double")
    given = graph.contributions(all_nodes, edges, known).withColumn("contribution", F.round("contribution", 12))
    own = matrix.table(score=score, degree=degree).filter("degree > 0").join(p.numbers, "book_id").withColumn("contribution", F.round(0.85 * F.col("score") / F.col("degree"), 12))
    assert told(graph.top_of(matrix, p, own, 3), "id", "place", "neighbour") == told(graph.top_contributions(given, 3), "id", "place", "neighbour")


def test_tiles_of_books_that_share_nothing(spark):
    index = spark.createDataFrame([("a", 1, 1), ("b", 2, 4)], "word string, book_id long, count long")
    p = tiles.packed(index)
    assert told(tiles.degrees(p, (0.5,)), "id") == []
    assert told(graph.connectivity_of(nodes(spark, [1, 2]), p, (0.5,)), "edges", "isolated", "components", "largest_component") == [(0, 2, 2, 1)]
    score, _, base = tiles.pagerank(tiles.Matrix(p, tiles.bits(p, 0.5)), 2)
    assert len(score) == 0 and base == pytest.approx(0.5)


def test_edges_are_counted_and_checked_in_the_tiles(spark, monkeypatch):
    """the checks of all edges from the bits, in blocks of any size, as from written edges."""
    from lexigraph.operators import checks

    ids, index, near = clustered(spark)
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in near.items()], "a long, b long, similarity double")
    for size in (13, 40, 1024):
        p = tiles.packed(index, size)
        assert [tuple(r) for r in tiles.Matrix(p, tiles.bits(p, 0.5)).faults().collect()] == [tuple(r) for r in checks.edge_faults(edges, 0.5).collect()] == [(len(near), 0, 0)]
    # similarities beyond 1, and the same book twice
    for data, wrong in (((1.5, 0.6, 0.7, 0.2), 1), ((0.9, 0.6, 0.7, 0.8), 0)):
        monkeypatch.setattr(tiles, "similarity", lambda least, most: np.array(data).reshape(2, 2))
        one, two, three = (tiles.Cell(k, np.array(own), b"") for k, own in ((0, [1, 2]), (1, [3, 4]), (2, [2, 5])))
        told = next(tiles.Bits(0.5).tile(one, two, None, None, None))
        assert told["invalid"] == [wrong] and told["edges"] == [sum(x > 0.5 for x in data)]
        assert next(tiles.Bits(0.5).tile(one, three, None, None, None))["invalid"] == [wrong + 1]  # 2 meets 2


@pytest.mark.parametrize("high,wide", [(1, 1), (5, 8), (30, 77)])
def test_products_of_bits(high, wide):
    draw = np.random.default_rng(9)
    hit, x, y = draw.random((high, wide)) < 0.4, draw.random(high), draw.random(wide)
    across, down = tiles.products(np.packbits(hit, axis=1).tobytes(), wide, x, y)
    assert across == pytest.approx(hit @ y) and down == pytest.approx(x @ hit)
