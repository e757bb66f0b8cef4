"""Keyword and pattern search: matching, ranking, pages, recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import Pattern
from .graph import neighbours
from .index import occurrences

SEEDS = 3
RECOMMENDED = 6
SHOWN_TERMS = 30
#: Matched words that are asked for by name; more are joined.
NAMED_TERMS = 500


@dataclass(frozen=True)
class Query:
    """A checked search request; ``ValueError`` for what isn't one."""

    text: str
    mode: str = "keyword"
    ranking: str = "pagerank"
    page: int = 1
    page_size: int = 12

    def __post_init__(self):
        object.__setattr__(self, "text", self.text.strip())
        if not 1 <= len(self.text) <= 128:
            raise ValueError("A query has 1 to 128 characters.")
        if self.mode not in ("keyword", "regex") or self.ranking not in ("pagerank", "frequency"):
            raise ValueError("Unknown mode or ranking.")
        if self.page < 1 or not 1 <= self.page_size <= 50:
            raise ValueError("Page or page size out of range.")
        if self.mode == "keyword":
            self.keyword()
        else:
            self.pattern()

    def keyword(self) -> str:
        words = T.query_tokens(self.text)
        if len(words) != 1:
            raise ValueError("A keyword is one word; alternatives are for regex mode.")
        return words[0]

    def pattern(self) -> Pattern:
        # The pattern is folded like the vocabulary, but is not normalised otherwise.
        return Pattern(self.text.casefold())


def matched_terms(terms: DataFrame, query: Query) -> DataFrame:
    """The words of the vocabulary that the query means. Equality and ranges of
    first characters are plain comparisons, which Parquet's statistics serve."""
    word = F.col("word")
    if query.mode == "keyword":
        return terms.filter(word == query.keyword()).select("word")
    pattern = query.pattern()
    near = pattern.prefilter(word)
    found = terms if near is None else terms.filter(near)
    return found.filter(pattern.matches(word)).select("word")


def hits(index: DataFrame, terms: DataFrame, query: Query, scores: DataFrame | None, words: list[str] | None = None) -> DataFrame:
    """book_id, occurrences and pagerank (0 if unknown) of every match. A
    keyword is compared with the postings themselves, without the vocabulary,
    and so are a pattern's ``words``, where the caller has them all."""
    if query.mode == "keyword":
        found = index.filter(F.col("word") == query.keyword()).groupBy("book_id").agg(F.sum("count").alias("occurrences"))
    elif words is not None:
        found = index.filter(F.col("word").isin(words)).groupBy("book_id").agg(F.sum("count").alias("occurrences"))
    else:
        found = occurrences(index, matched_terms(terms, query))
    if scores is None:
        return found.select("book_id", "occurrences", F.lit(0.0).alias("pagerank"))
    return found.join(scores, "book_id", "left").select("book_id", "occurrences", F.coalesce("score", F.lit(0.0)).alias("pagerank"))


def ranking_order(ranking: str) -> list[Column]:
    keys = [F.desc("pagerank"), F.desc("occurrences")]
    return [*(keys if ranking == "pagerank" else reversed(keys)), F.asc("book_id")]


def page_of(found: DataFrame, books: DataFrame, query: Query) -> DataFrame:
    """The page's books in order (column place: from 1 over all hits). A
    top-k of page * page_size rows, not a sort of all hits in one task."""
    order = ranking_order(query.ranking)
    last = query.page * query.page_size
    top = found.orderBy(*order).limit(last)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*order))).filter(F.col("place") > last - query.page_size)
    return placed.join(books, placed["book_id"] == books["id"]).select("place", "id", "title", "author", "source", "words", "excerpt", "occurrences", "pagerank")


def term_list(terms: DataFrame, query: Query) -> tuple[list[str], int]:
    """The first matched words (all, if there are no more than NAMED_TERMS) and
    the number of all, in one job."""
    seen = Observation()
    words = matched_terms(terms, query).observe(seen, F.count(F.lit(1)).alias("n")).orderBy("word").limit(NAMED_TERMS).collect()
    return [r["word"] for r in words], seen.get["n"]


def first_page(found: DataFrame, books: DataFrame, query: Query) -> tuple[int, list[dict]]:
    """The number of all hits and the page's books in order: one job counts and
    ranks, a second one looks up the page's books."""
    seen, last = Observation(), query.page * query.page_size
    top = found.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*ranking_order(query.ranking)).limit(last).collect()[last - query.page_size :]
    if not top:
        return seen.get["n"], []
    known = {r["id"]: r.asDict() for r in books.filter(F.col("id").isin([r["book_id"] for r in top])).select("id", "title", "author", "source", "words", "excerpt").collect()}
    return seen.get["n"], [known[r["book_id"]] | {"occurrences": r["occurrences"], "pagerank": r["pagerank"]} for r in top]


def seeds(found: DataFrame, ranking: str) -> DataFrame:
    """The best hits, whose neighbours are recommended; seed_place from 1."""
    order = ranking_order(ranking)
    return found.orderBy(*order).limit(SEEDS).withColumn("seed_place", F.row_number().over(Window.orderBy(*order)))


def recommendations(found: DataFrame, links: DataFrame, books: DataFrame, ranking: str, limit: int = RECOMMENDED) -> DataFrame:
    """Neighbours of the three best hits that aren't hits themselves, by their
    best similarity; related_to is the hit that gives it (the better-ranked one
    among equals). ``links`` needs no other edges than those of the seeds."""
    near = neighbours(links).join(F.broadcast(seeds(found, ranking).select(F.col("book_id").alias("src"), "seed_place")), "src")  # three rows
    near = near.join(found.select(F.col("book_id").alias("dst")), "dst", "left_anti")
    best = near.groupBy("dst").agg(F.max(F.struct("similarity", (-F.col("seed_place")).alias("turn"), "src")).alias("best"))
    top = best.orderBy(F.desc("best.similarity"), "dst").limit(limit)
    out = top.join(books, F.col("dst") == books["id"]).select("id", "title", "author", "source", "words", F.round("best.similarity", 6).alias("similarity"), F.col("best.src").alias("related_to"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))
