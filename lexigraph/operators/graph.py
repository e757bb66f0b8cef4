"""The similarity graph of books, PageRank and connectivity.

Similarity of two books is the sum of smaller counts over the sum of larger
counts of the words both contain. One shared word can make it 1, so no prefix,
length or sketch filter is sound: every pair that shares a word counts.

``overlaps`` and ``edges`` compare the books block by block (see ``tiles``), so
no join emits a row per pair and word and memory is bounded.
``overlaps_by_join`` is the same as a plain join and aggregate.

Components and isolated books don't need every edge. ``joined_components`` and
``isolated`` compare all books with a few probes, those that this leaves open
with more probes, and the last of them with every book; ``isolated`` does it
where a book's bag is read, without a shuffle (``tiles.beside``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import saved, swept
from . import tiles

#: Edges up to which PageRank runs in one task; beyond, as joins.
SMALL_EDGES = 2_000_000
#: Books that all are compared with at first, and how many times as many in each later turn.
PROBES, MORE_PROBES = 16, 8
#: Ids and postings up to which a join broadcasts them.
FEW_IDS, FEW_POSTINGS = 1_000_000, 500_000
#: Books whose postings the driver may hold at once, to be compared with others.
MOST_PROBES = 2048
#: The similarity's name in a graph's metadata (fixed value).
METRIC = "lecture3-weighted-shared"


def check_threshold(threshold: float) -> None:
    if not 0 <= threshold < 1:
        raise ValueError("The similarity threshold must be at least 0 and below 1.")


def overlaps_by_join(index: DataFrame) -> DataFrame:
    left = index.select("word", F.col("book_id").alias("a"), F.col("count").alias("x"))
    right = index.select("word", F.col("book_id").alias("b"), F.col("count").alias("y"))
    met = left.join(right, "word").filter("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("shared_words"), F.sum(F.least("x", "y")).alias("minimum"), F.sum(F.greatest("x", "y")).alias("maximum"))


def overlaps(index: DataFrame, threshold: float = -1.0, blocks: int | None = None) -> DataFrame:
    """a < b, shared_words, minimum and maximum (sums over shared words) of all
    pairs that share a word and are more similar than ``threshold``."""
    size = tiles.BLOCK if blocks is None else max(1, -(-index.select("book_id").distinct().count() // blocks))
    return tiles.over(tiles.packed(index, size), lambda: tiles.Pairs(threshold, True)).select("a", "b", "shared_words", "minimum", "maximum")


def similarities(pairs: DataFrame) -> DataFrame:
    """Adds similarity and distance."""
    similarity = F.when(F.col("maximum") > 0, F.col("minimum") / F.col("maximum")).otherwise(0.0)
    return pairs.withColumn("similarity", similarity).withColumn("distance", 1 - F.col("similarity"))


def edges(index: DataFrame, threshold: float = 0.5) -> DataFrame:
    """a < b and similarity of all pairs above the threshold, strictly."""
    check_threshold(threshold)
    return tiles.over(tiles.packed(index), lambda: tiles.Pairs(threshold, False)).select("a", "b", "similarity")


def few(rows: DataFrame, most: int = FEW_IDS) -> DataFrame:
    """A written table of ids, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= most else rows


def edges_between(index: DataFrame, own: DataFrame, others: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """The edges from the books ``own`` to ``others`` (all if None), both given
    by a column id. Work and rows are as the postings of ``own`` meet the others'."""
    check_threshold(threshold)

    def chosen(ids: DataFrame) -> DataFrame:
        return index.join(few(saved(ids.select(F.col("id").alias("book_id")).distinct(), "chosen")), "book_id", "left_semi")

    left = few(saved(chosen(own).select("word", F.col("book_id").alias("src"), F.col("count").alias("x")), "own"), FEW_POSTINGS)
    right = (index if others is None else chosen(others)).select("word", F.col("book_id").alias("dst"), F.col("count").alias("y"))
    sums = right.join(left, "word").filter("src != dst").groupBy("src", "dst").agg(F.sum(F.least("x", "y")).alias("minimum"), F.sum(F.greatest("x", "y")).alias("maximum"))
    near = similarities(sums).filter(F.col("similarity") > threshold)
    return near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "similarity").distinct()


def by_turns(nodes: DataFrame, index: DataFrame, threshold: float, left_open: Callable[[DataFrame], DataFrame], probes: int = PROBES) -> None:
    """Hands ``left_open`` edges turn by turn; it returns the ids whose other
    edges still matter. Nothing is left out: as soon as more probes don't help,
    those ids are compared with all books, or all books with each other."""
    ids = saved(nodes.select("id").distinct(), "nodes")
    n = count = ids.count()
    rest = None
    while probes < n // 2:
        before, probe = count, ids.orderBy(F.xxhash64("id", F.lit(probes)), "id").limit(probes)
        rest = saved(left_open(edges_between(index, probe, rest, threshold)), "rest")
        count = rest.count()
        probes *= MORE_PROBES
        swept(index.sparkSession)
        if not count:
            return
        if 4 * count > 3 * before:
            break
    left_open(edges(index, threshold) if rest is None or 2 * count > n else edges_between(index, rest, None, threshold))


def joined_components(nodes: DataFrame, index: DataFrame, threshold: float = 0.5, probes: int = PROBES) -> DataFrame:
    """id and component (its smallest id) of every node, from the postings: an
    edge inside the largest component found so far changes nothing, so only
    edges of the other nodes still matter."""
    labels = saved(nodes.select("id", F.col("id").alias("component")).distinct(), "labels")

    def left_open(links: DataFrame) -> DataFrame:
        nonlocal labels
        of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
        met = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter("of_a != of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
        tops = components(labels.select(F.col("component").alias("id")), met).select(F.col("id").alias("old"), F.col("component").alias("new"))
        labels = saved(labels.join(tops, F.col("component") == F.col("old")).select("id", F.col("new").alias("component")), "labels")
        largest = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
        return labels.join(F.broadcast(largest), "component", "left_anti").select("id")

    by_turns(nodes, index, threshold, left_open, probes)
    return labels


def bags_of(index: DataFrame) -> DataFrame:
    """A row for each book: book_id, words, counts."""
    return index.groupBy("book_id").agg(F.collect_list(F.struct("word", "count")).alias("held")).select("book_id", F.col("held.word").alias("words"), F.col("held.count").alias("counts"))


def index_of(bags: DataFrame) -> DataFrame:
    """word, book_id and count of every word of every bag."""
    return bags.select("book_id", F.explode(F.arrays_zip("words", "counts")).alias("held")).select(F.col("held.words").alias("word"), "book_id", F.col("held.counts").alias("count"))


def own_bags(bags: DataFrame, ids: DataFrame) -> pa.Table:
    """The bags of a few books, on the driver, in the order of their ids."""
    return bags.join(F.broadcast(ids.select(F.col("id").alias("book_id"))), "book_id", "left_semi").select("book_id", "words", "counts").orderBy("book_id").toArrow()


def edges_of(bags: DataFrame, ids: list[int], threshold: float = 0.5) -> DataFrame:
    """``edges_between`` a few books, by id, and all, from a row for each book, written."""
    check_threshold(threshold)
    own = bags.filter(F.col("book_id").isin(ids)).select("book_id", "words", "counts").toArrow()
    return saved(tiles.beside(bags, own, threshold), "edges")


def isolated(nodes: DataFrame, index: DataFrame | None, threshold: float = 0.5, probes: int = PROBES * MORE_PROBES, bags: DataFrame | None = None) -> DataFrame:
    """id of every node without an edge, from the postings, or from ``bags`` (see ``bags_of``): once a
    node has an edge, its other ones don't matter. All books meet a few probes, those left
    open more of them, until they are few themselves and meet all books; where more probes
    don't help, all pairs are compared."""
    check_threshold(threshold)
    bags = saved(bags_of(index), "bags") if bags is None else bags
    rest = saved(nodes.select("id").distinct(), "nodes")
    n = count = rest.count()
    ids, open_bags = rest, bags
    while count > probes and 2 * probes < n and probes <= MOST_PROBES:
        before, probe = count, ids.orderBy(F.xxhash64("id", F.lit(probes)), "id").limit(probes)
        met = tiles.beside(open_bags, own_bags(bags, probe), threshold, True)
        rest = saved(rest.join(met, "id", "left_anti"), "isolated")
        count = rest.count()
        open_bags = bags.join(few(rest.select(F.col("id").alias("book_id"))), "book_id", "left_semi")
        probes *= MORE_PROBES
        if 4 * count > 3 * before:
            break
    if count <= MOST_PROBES:
        own = own_bags(bags, rest)
        return saved(rest.join(tiles.beside(bags, own, threshold, True), "id", "left_anti"), "isolated") if own.num_rows else rest
    index = index_of(bags) if index is None else index
    links = edges(index, threshold) if 2 * count > n else edges_between(index, rest, None, threshold)
    return saved(rest.join(both_ways(links).select(F.col("src").alias("id")), "id", "left_anti"), "isolated")


def both_ways(links: DataFrame) -> DataFrame:
    """src, dst for each direction."""
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def neighbours(links: DataFrame) -> DataFrame:
    """src, dst, similarity for each direction."""
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity").unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"), "similarity"))


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id and degree of every node."""
    found = both_ways(links).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


class NotConverged(ValueError):
    pass


def power_iteration(ids: np.ndarray, a: np.ndarray, b: np.ndarray, damping: float, tolerance: float, rounds: int) -> tuple[np.ndarray, int]:
    """PageRank of nodes ``ids`` with undirected edges (a, b)."""
    n = len(ids)
    if n == 0:
        return np.zeros(0), 0
    src = np.searchsorted(ids, np.concatenate([a, b]))
    dst = np.searchsorted(ids, np.concatenate([b, a]))
    degree = np.bincount(src, minlength=n)
    rank = np.full(n, 1.0 / n)
    for turn in range(1, rounds + 1):
        share = np.divide(rank, degree, out=np.zeros(n), where=degree > 0)
        after = (1 - damping + damping * rank[degree == 0].sum()) / n + damping * np.bincount(dst, share[src], n)
        if np.abs(after - rank).sum() < tolerance:
            return after, turn
        rank = after
    raise NotConverged("PageRank did not converge.")


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, max_iterations: int = 200) -> tuple[DataFrame, int]:
    """(book_id, score) of all nodes, and the number of iterations.

    Up to SMALL_EDGES edges and nodes one executor task iterates over arrays;
    beyond, each iteration is a join with the ranks and an aggregate, and the
    ranks are cut from their lineage in the shared folder."""
    ids = nodes.select(F.col("id").cast("long").alias("id")).distinct()
    if max(links.count(), ids.count()) <= SMALL_EDGES:
        rows = ids.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(links.select(F.col("a").cast("long"), F.col("b").cast("long")))

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            alone = rows["b"].isna()
            own = np.sort(rows.loc[alone, "a"].to_numpy(np.int64))
            try:
                score, turns = power_iteration(own, rows.loc[~alone, "a"].to_numpy(np.int64), rows.loc[~alone, "b"].to_numpy(np.int64), damping, tolerance, max_iterations)
            except NotConverged:
                score, turns = np.zeros(len(own)), -1
            return pd.DataFrame({"book_id": own, "score": score, "turns": turns})

        found = saved(rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "book_id long, score double, turns int"), "scores")
        first = found.select("turns").first()
        if first and first["turns"] < 0:
            raise NotConverged("PageRank did not converge.")
        return found.select("book_id", "score"), first["turns"] if first else 0
    return pagerank_by_join(ids, links, damping, tolerance, max_iterations)


def pagerank_by_join(nodes: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, max_iterations: int = 200) -> tuple[DataFrame, int]:
    n = nodes.count()
    if not n:
        return nodes.select(F.col("id").alias("book_id"), F.lit(0.0).alias("score")), 0
    flow = saved(both_ways(links).join(both_ways(links).groupBy("src").agg(F.count("*").alias("degree")), "src"), "adjacency")
    lonely = nodes.join(flow.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("lonely"))
    own = saved(nodes.join(lonely, "id", "left").select("id", F.coalesce("lonely", F.lit(False)).alias("lonely")), "nodes")
    ranks = own.withColumn("rank", F.lit(1.0 / n))
    for turn in range(1, max_iterations + 1):
        dangling = ranks.agg(F.coalesce(F.sum(F.when(F.col("lonely"), F.col("rank"))), F.lit(0.0))).first()[0]
        base = (1 - damping + damping * dangling) / n
        sent = flow.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        step = saved(ranks.join(sent, "id", "left").select("id", "lonely", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("after"), F.col("rank").alias("before")), "ranks")
        delta = step.agg(F.sum(F.abs(F.col("after") - F.col("before")))).first()[0]
        ranks = step.select("id", "lonely", F.col("after").alias("rank"))
        if delta < tolerance:
            return ranks.select(F.col("id").alias("book_id"), F.col("rank").alias("score")), turn
    raise NotConverged("PageRank did not converge.")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node: min-label propagation
    with pointer jumping."""
    both = saved(both_ways(links), "directions")
    labels = saved(nodes.select("id", F.col("id").alias("label")).distinct(), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        after = saved(step.join(jump, "next").select("id", "label", F.least("next", "far").alias("after")), "labels")
        labels = after.select("id", F.col("after").alias("label"))
        if after.filter("label != after").isEmpty():
            return labels.select("id", F.col("label").alias("component"))


def connectivity(nodes: DataFrame, links: DataFrame, thresholds: tuple[float, ...], stored: float | None = None, index: DataFrame | None = None) -> DataFrame:
    """A row for each threshold: edges, density, mean degree, isolated nodes,
    components and the largest one. Edges ``stored`` for a threshold serve all
    stricter ones; for a lower one pairs are compared anew, from ``index``."""
    if stored is not None and min(thresholds) < stored:
        if index is None:
            raise ValueError("Thresholds below the stored one need the index.")
        links = saved(edges(index, min(thresholds)), "edges")
    n = nodes.count()
    out: DataFrame | None = None
    for level in sorted(set(thresholds)):
        above = links.filter(F.col("similarity") > level)
        sizes = components(nodes, above).groupBy("component").agg(F.count("*").alias("size"))
        parts = sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component"))
        isolated = degrees(nodes, above).agg(F.coalesce(F.sum((F.col("degree") == 0).cast("long")), F.lit(0)).alias("isolated"))
        count = above.agg(F.count("*").alias("edges"))
        row = count.crossJoin(isolated).crossJoin(parts).select(
            F.lit(float(level)).alias("threshold"), "edges",
            (2.0 * F.col("edges") / max(n * (n - 1), 1)).alias("density"), (2.0 * F.col("edges") / max(n, 1)).alias("mean_degree"), "isolated", "components", "largest_component",
        )
        out = row if out is None else out.unionByName(row)
    return out


def connectivity_of(nodes: DataFrame, p: tiles.Packed, levels: tuple[float, ...]) -> DataFrame:
    """``connectivity`` from the postings: no edge is kept, only each book's
    number of them and what joins the books, by level."""
    for level in levels:
        check_threshold(level)
    levels = tuple(sorted(set(levels)))
    n, known, size = nodes.count(), p.numbers.count(), p.size
    found = saved(tiles.over(p, lambda: tiles.Levels(levels, size)), "levels")
    level = F.explode(F.array(*(F.lit(k) for k in range(len(levels))))).alias("level")
    at = lambda number: F.col(number) * len(levels) + F.col("level")
    places = p.numbers.select("number", level).select(at("number").alias("id"))
    joins = found.filter("b is not null").select(at("a").alias("a"), at("b").alias("b"))
    sizes = components(places, joins).groupBy("component").agg(F.count("*").alias("size")).groupBy((F.col("component") % len(levels)).cast("int").alias("level"))
    parts = sizes.agg((F.count("*") + (n - known)).alias("components"), F.max("size").alias("largest_component"))
    degree = found.filter("b is null").groupBy("level", "a").agg(F.sum("degree").alias("degree"))
    counts = degree.groupBy("level").agg((F.sum("degree") / 2).cast("long").alias("edges"), (n - F.count("*")).alias("isolated"))
    all_levels = nodes.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(levels)], "level int, threshold double")
    out = all_levels.join(parts, "level", "left").join(counts, "level", "left").select("threshold", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("isolated", F.lit(n)).cast("long").alias("isolated"), F.coalesce("components", F.lit(n)).cast("long").alias("components"), F.coalesce("largest_component", F.lit(min(n, 1))).cast("long").alias("largest_component"))
    return out.select("threshold", "edges", (2.0 * F.col("edges") / max(n * (n - 1), 1)).alias("density"), (2.0 * F.col("edges") / max(n, 1)).alias("mean_degree"), "isolated", "components", "largest_component")


def decomposition(nodes: DataFrame, links: DataFrame, scores: DataFrame, damping: float = 0.85) -> DataFrame:
    """One PageRank step taken apart for every node: teleportation, dangling
    share, neighbours' total, the recomputed score and its residual."""
    n = nodes.count()
    deg = degrees(nodes, links)
    known = deg.join(scores.withColumnRenamed("book_id", "id"), "id")
    dangling = known.agg(F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("score"))), F.lit(0.0)).alias("dangling"))
    got = contributions(nodes, links, scores, damping).groupBy("id").agg(F.sum("contribution").alias("neighbours"))
    out = known.join(got, "id", "left").crossJoin(F.broadcast(dangling))
    out = out.select("id", "degree", "score", F.lit((1 - damping) / max(n, 1)).alias("teleportation"), (damping * F.col("dangling") / max(n, 1)).alias("dangling_share"), F.coalesce("neighbours", F.lit(0.0)).alias("neighbour_total"))
    out = out.withColumn("recomputed", F.col("teleportation") + F.col("dangling_share") + F.col("neighbour_total"))
    return out.withColumn("residual", F.abs(F.col("recomputed") - F.col("score")))


def contributions(nodes: DataFrame, links: DataFrame, scores: DataFrame, damping: float = 0.85) -> DataFrame:
    """What each neighbour gives to each node's score: id, neighbour, its
    pagerank and degree, contribution."""
    giver = degrees(nodes, links).join(scores.withColumnRenamed("book_id", "id"), "id").select(F.col("id").alias("src"), F.col("score").alias("pagerank"), "degree")
    return both_ways(links).join(giver, "src").select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "pagerank", "degree", (damping * F.col("pagerank") / F.col("degree")).alias("contribution"))


def top_contributions(given: DataFrame, k: int = 5) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("contribution"), "neighbour"))
    return given.withColumn("place", turn).filter(F.col("place") <= k)


def decomposed(scored: DataFrame, damping: float = 0.85) -> DataFrame:
    """``decomposition`` of scores that come with each book's degree and what it has ``got``:
    the sum of its neighbours' scores over their degrees."""
    n = scored.count()
    dangling = scored.agg(F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("score"))), F.lit(0.0)).alias("dangling"))
    out = scored.crossJoin(F.broadcast(dangling)).select(
        F.col("book_id").alias("id"), "degree", "score", F.lit((1 - damping) / max(n, 1)).alias("teleportation"),
        (damping * F.col("dangling") / max(n, 1)).alias("dangling_share"), (damping * F.col("got")).alias("neighbour_total"),
    )
    out = out.withColumn("recomputed", F.col("teleportation") + F.col("dangling_share") + F.col("neighbour_total"))
    return out.withColumn("residual", F.abs(F.col("recomputed") - F.col("score")))


def top_of(matrix: tiles.Matrix, p: tiles.Packed, own: DataFrame, k: int = 5) -> DataFrame:
    """``top_contributions`` from the adjacency matrix and what every book with an edge gives to each of
    its neighbours: book_id, number, degree, contribution."""
    given = own.toPandas().sort_values(["contribution", "book_id"], ascending=[False, True])
    rank = np.full(matrix.n, matrix.n, np.int64)
    rank[given["number"].to_numpy()] = np.arange(len(given))
    ranked = matrix.table(rank=rank).join(own, "book_id").select("rank", F.col("book_id").alias("neighbour"), "degree", "contribution")
    met = matrix.first(rank, k).join(F.broadcast(ranked), "rank").join(F.broadcast(p.numbers), "number")
    return met.select(F.col("book_id").alias("id"), "place", "neighbour", "degree", "contribution")


def pair_examples(books: DataFrame, index: DataFrame, ids: tuple[int, ...], threshold: float) -> DataFrame:
    """Worked similarities of all pairs of the given books that share a word or
    not, with the number of distinct words of each."""
    own = index.filter(F.col("book_id").isin(*ids))
    distinct = own.groupBy("book_id").agg(F.count("*").alias("unique_words"))
    chosen = books.filter(F.col("id").isin(*ids)).select("id", "title", "words").join(distinct, F.col("id") == F.col("book_id"), "left").select("id", "title", F.coalesce("unique_words", F.lit(0)).alias("unique_words"))
    x, y = chosen.alias("x"), chosen.alias("y")
    pairs = x.join(y, F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.unique_words").alias("unique_words_a"), F.col("y.unique_words").alias("unique_words_b"))
    found = similarities(pairs.join(overlaps_by_join(own), ["a", "b"], "left").fillna(0, ["shared_words", "minimum", "maximum"]))
    return found.withColumn("is_edge", F.col("similarity") > threshold)
