"""The library: one object for importing, graph building, search and checks."""

from __future__ import annotations

import json
import threading
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, graph, index, ingest, search
from .plans.storage import Store, saved

SEARCH_SECONDS = 8.0
#: Parts of a table at which an import merges them.
PARTS = 25


class Library:
    """Tables under ``path``. Each import adds parts, each graph makes new ones, and
    then the next pointer names them: a failure changes nothing and readers aren't
    disturbed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        self._open: tuple[str, dict, dict[str, DataFrame]] | None = None

    # Reading

    def opened(self) -> tuple[dict, dict[str, DataFrame]]:
        """The current pointer and its tables, kept in memory until it changes."""
        at = self.store.pointer()
        key = json.dumps(at, sort_keys=True)
        if self._open is None or self._open[0] != key:
            if self._open:
                for df in self._open[2].values():
                    df.unpersist()
            self._open = key, at, {n: self.store.read(n, at).persist(StorageLevel.MEMORY_AND_DISK) for n in ("books", "terms", "postings", "edges", "scores")}
        return self._open[1:]

    def tables(self) -> dict[str, DataFrame]:
        return self.opened()[1]

    def graph_info(self) -> dict | None:
        return self.store.graph()

    # Importing

    def import_books(self, rows: DataFrame, min_words: int = ingest.MIN_WORDS, strict: bool = True, refresh: bool = False) -> int:
        """Add the rows (id, text, title, author, source) that are new by id and
        by content; returns how many. ``strict``: a short one is an error and
        nothing is added; else short ones are left out. ``refresh``: books already
        known get the digest of their present text.

        Texts are cleaned once and tokenized once; what is written follows the
        new rows, not the library."""
        at = self.store.pointer()
        to, books = dict(at), self.store.read("books", at)
        if refresh and at.get("books"):
            changed = saved(ingest.refreshed_digests(books, rows), "refreshed")
            if not changed.join(books.select("id", "digest"), ["id", "digest"], "left_anti").isEmpty():
                to["books"] = [self.store.write(changed, "books")]
                books = self.store.read("books", to)
        stage = ingest.staged(rows, books if at.get("books") else None)
        counts = ingest.word_counts(stage)
        fresh = saved(ingest.accepted(stage, counts, min_words, books if at.get("books") else None, strict), "books")
        count = fresh.count()
        if count:
            own = counts.join(fresh.select("turn", F.col("id").alias("book_id")), "turn").select("word", "book_id", "count")
            posts = self.store.write(index.laid_out(own), "postings")
            new = index.vocabulary(self.store.read("postings", {"postings": [posts]}))
            if at.get("terms"):
                new = ingest.without(new, self.store.read("terms", at), "word")
            to["books"] = [*to.get("books", []), self.store.write(fresh, "books")]
            to["terms"] = [*to.get("terms", []), self.store.write(new.repartitionByRange("word").sortWithinPartitions("word"), "terms")]
            # The graph was of the old postings, and is absent from now on.
            to["postings"] = [*to.get("postings", []), posts]
            if len(to["postings"]) > PARTS:
                to = self.compacted(to)
        if to != at:
            self.store.point(to)
        return count

    def compacted(self, at: dict) -> dict:
        """A pointer to the same rows in one part for each table; the graph stays."""
        to = dict(at)
        for name, key in (("books", "id"), ("terms", "word")):
            to[name] = [self.store.write(self.store.read(name, at).repartitionByRange(key).sortWithinPartitions(key), name)]
        to["postings"] = [self.store.write(index.laid_out(self.store.read("postings", at)), "postings")]
        if self.store.graph(at):
            to["graph_of"] = to["postings"]
        return to

    def compact(self) -> None:
        at = self.store.pointer()
        if any(len(at.get(n, [])) > 1 for n in ("books", "terms", "postings")):
            self.store.point(self.compacted(at))

    def index_books(self, rows: DataFrame, min_words: int = ingest.MIN_WORDS) -> int:
        """Import a folder's books; those already known get the digest of their
        present text. One pointer for both."""
        return self.import_books(rows, min_words, refresh=True)

    def subset(self, path: str, count: int) -> "Library":
        """A library of the first ``count`` ids, with the graph's edges among
        them and their scores."""
        at, other = self.store.pointer(), Library(self.spark, path)
        books = self.store.read("books", at).orderBy("id").limit(count)
        wanted = books.select("id")
        posts = self.store.read("postings", at)
        own = posts.join(wanted, posts["book_id"] == wanted["id"], "left_semi")
        to = {"books": [other.store.write(books, "books")], "postings": [other.store.write(index.laid_out(own), "postings")]}
        to["terms"] = [other.store.write(index.vocabulary(own), "terms")]
        if self.store.graph(at):
            links, scores = self.store.read("edges", at), self.store.read("scores", at)
            inner = links.join(wanted, links["a"] == wanted["id"], "left_semi").join(wanted, links["b"] == wanted["id"], "left_semi")
            to |= {"edges": [other.store.write(inner, "edges")], "scores": [other.store.write(scores.join(wanted, scores["book_id"] == wanted["id"], "left_semi"), "scores")], "graph": at["graph"], "graph_of": to["postings"]}
        other.store.point(to)
        return other

    # The graph

    def build_graph(self, threshold: float = 0.5, damping: float = 0.85, tolerance: float = 1e-10) -> dict:
        """Edges above the threshold and PageRank; returns the metadata."""
        graph.check_threshold(threshold)
        started, at = time.perf_counter(), self.store.pointer()
        books, posts = self.store.read("books", at), self.store.read("postings", at)
        version = self.store.write(graph.edges(posts, threshold), "edges")
        links = self.spark.read.schema("a long, b long, similarity double").parquet(f"{self.store.path}/{version}")
        scores, turns = graph.pagerank(books.select("id"), links, damping, tolerance)
        info = {
            "threshold": threshold, "distance_threshold": 1 - threshold, "comparison": "similarity > threshold", "metric": graph.METRIC, "nodes": books.count(), "edges": links.count(), "iterations": turns, "damping": damping, "tolerance": tolerance,
            "representation": "occurrence counts", "empty_intersection_distance": 1, "ranking": "pagerank", "seconds": round(time.perf_counter() - started, 6),
        }
        self.store.point(at | {"edges": [version], "scores": [self.store.write(scores, "scores")], "graph": info, "graph_of": at.get("postings")})
        return info

    # Searching

    def search(self, query: str, mode: str = "keyword", ranking: str = "pagerank", page: int = 1, page_size: int = 12, budget: float = SEARCH_SECONDS) -> dict:
        """A page of results with recommendations; ``ValueError`` for what isn't
        a query, and for one that takes longer than ``budget`` seconds."""
        started = time.perf_counter()
        asked = search.Query(query, mode, ranking, page, page_size)
        at, t = self.opened()
        tag = f"search-{id(asked)}-{time.monotonic_ns()}"
        late = threading.Timer(budget, self.spark.interruptTag, [tag])
        self.spark.addTag(tag)
        late.start()
        try:
            words, term_count = search.term_list(t["terms"], asked) if mode == "regex" else ([asked.keyword()], 1)
            shown, named = words[: search.SHOWN_TERMS], words if len(words) == term_count else None
            found = search.hits(t["postings"], t["terms"], asked, t["scores"] if self.store.graph(at) else None, named)
            total, results = search.first_page(found, t["books"], asked)
            if not total and mode == "keyword":
                shown, term_count = [], 0
            ready = self.store.graph(at) is not None
            near = [r.asDict() for r in search.recommendations(found, t["edges"], t["books"], ranking).orderBy("place").drop("place").collect()] if total and ready else []
        except Exception as error:
            if time.perf_counter() - started > budget:
                raise ValueError("This query takes too long; try a more specific one.") from error
            raise
        finally:
            late.cancel()
            self.spark.removeTag(tag)
        if time.perf_counter() - started > budget:
            raise ValueError("This query takes too long; try a more specific one.")
        return {
            "query": asked.text, "mode": mode, "ranking": ranking, "total": total, "page": page, "page_size": page_size, "results": results, "matched_terms": shown, "matched_term_count": term_count, "recommendations": near,
            "graph_ready": ready, "elapsed_ms": round((time.perf_counter() - started) * 1000, 2),
        }

    # Checking

    def stats(self) -> dict:
        t = self.tables()
        return checks.corpus_stats(t["books"], t["terms"]).first().asDict() | {"graph": self.graph_info()}

    def validate(self) -> dict:
        t = self.tables()
        return {"stats": self.stats(), "checks": checks.checks(t["books"], t["terms"], t["postings"], t["edges"], t["scores"], self.graph_info(), graph.METRIC, self.intact())}

    def intact(self) -> bool:
        """Whether every current table can be read with its schema."""
        try:
            return all(df.select(F.count("*")).first()[0] >= 0 for df in self.tables().values())
        except Exception:
            return False
