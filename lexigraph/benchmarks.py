"""Measurements: a library's growth over nested subsets, and its HTTP interface
under several clients. Samples and summaries are tables, summarised by
``operators.latency``."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession

from .library import Library
from .operators import ingest, latency
from .server import make_server
from .sources import files, reports

#: (mode, query) of a run unless others are given.
QUERIES = (("keyword", "ocean"), ("keyword", "love"), ("regex", "sea|ocean"), ("regex", "adventur.*"))
SCALING = "books long, index_seconds double, graph_seconds double, edges long, stored_bytes long"
SAMPLES = "books long, mode string, query string, iteration long, ms double, results long"
ANSWERS = "clients long, request long, mode string, query string, status long, ms double, results long, error string"
CHARTS = (("index_seconds", "Index", "s"), ("graph_seconds", "Graph and PageRank", "s"), ("stored_bytes", "Tables", "bytes"))


def stored_bytes(library: Library) -> int:
    """Bytes of all files under the library's folder."""
    place = library.spark._jvm.org.apache.hadoop.fs.Path(library.store.path)
    return place.getFileSystem(library.spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def growth(rows: DataFrame, path: str, sizes: Iterable[int], queries: Sequence[tuple[str, str]] = QUERIES, repeats: int = 5, threshold: float = 0.5, min_words: int = ingest.MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Index, link and search the first rows by id, for each of ``sizes`` anew in
    a library of its own under ``path``. Returns a row for each size and all
    samples; both are written under ``path`` after each size, so that a failure at
    a larger one keeps them. ``ValueError`` if the rows are fewer than a size or
    hold repeated books, whose times would carry a wrong number."""
    spark, scaling, samples = rows.sparkSession, [], []
    sizes = sorted(set(sizes))
    if not sizes or sizes[0] < 1 or repeats < 1:
        raise ValueError("Sizes and repeats are at least one.")
    made: tuple[DataFrame, DataFrame] | None = None
    for size in sizes:
        library = Library(spark, f"{path}/library-{size}-{time.time_ns()}")
        began = time.perf_counter()
        count = library.import_books(rows.orderBy("id").limit(size), min_words)
        index_seconds = time.perf_counter() - began
        if count != size:
            raise ValueError(f"{size} books were asked for, {count} are there without repetitions.")
        began = time.perf_counter()
        info = library.build_graph(threshold)
        scaling.append((size, index_seconds, time.perf_counter() - began, info["edges"], stored_bytes(library)))
        for mode, query in queries:
            library.search(query, mode)  # the first answer isn't measured
            for turn in range(1, repeats + 1):
                began = time.perf_counter()
                total = library.search(query, mode)["total"]
                samples.append((size, mode, query, turn, (time.perf_counter() - began) * 1000, total))
        made = spark.createDataFrame(scaling, SCALING), spark.createDataFrame(samples, SAMPLES)
        for name, table in zip(("scaling", "query_samples", "query_medians"), (*made, latency.query_medians(made[1]))):
            files.write_csv(table, f"{path}/{name}")
    for column, title, unit in CHARTS:
        reports.write_text(spark, f"{path}/{column}.svg", reports.bar_chart(made[0], "books", column, title, unit))
    return made


def ask(base: str, mode: str, query: str, timeout: float = 30.0) -> tuple[int, float, int | None, str]:
    """Status (0: no answer), milliseconds, results and error of one search."""
    began = time.perf_counter()
    try:
        with urllib.request.urlopen(f"{base}/api/search?{urlencode({'q': query, 'mode': mode})}", timeout=timeout) as answer:
            status, body = answer.status, json.load(answer)
    except urllib.error.HTTPError as refused:
        status, body = refused.code, json.loads(refused.read())
    except OSError as lost:
        status, body = 0, {"error": str(lost)}
    return status, (time.perf_counter() - began) * 1000, body.get("total"), body.get("error", "")


def load(library: Library, clients: Iterable[int], requests: int = 100, queries: Sequence[tuple[str, str]] = QUERIES) -> tuple[DataFrame, DataFrame]:
    """Answers of ``requests`` searches by each number of clients at once, the
    queries in turn, over a server on this machine; and their summary. Each query
    is asked once before, and ``RuntimeError`` if that fails."""
    clients = sorted(set(clients))
    if not clients or clients[0] < 1 or requests < 1:
        raise ValueError("Clients and requests are at least one.")
    server = make_server(library, port=0)
    serving = threading.Thread(target=server.serve_forever, daemon=True)
    serving.start()
    base, answers, seconds = f"http://127.0.0.1:{server.server_address[1]}", [], []
    try:
        for mode, query in queries:
            status, _, _, error = ask(base, mode, query)
            if status != 200:
                raise RuntimeError(f"{mode} {query}: {status} {error}")
        for many in clients:
            began = time.perf_counter()
            with ThreadPoolExecutor(many) as pool:
                got = list(pool.map(lambda i: ask(base, *queries[i % len(queries)]), range(requests)))
            seconds.append((many, time.perf_counter() - began))
            answers += [(many, i + 1, *queries[i % len(queries)], *answer) for i, answer in enumerate(got)]
    finally:
        server.shutdown()
        server.server_close()
        serving.join()
    spark: SparkSession = library.spark
    samples = spark.createDataFrame(answers, ANSWERS)
    return samples, latency.http_summary(samples, spark.createDataFrame(seconds, "clients long, seconds double"))
