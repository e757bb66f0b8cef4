"""Catalogues, book folders and report files."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE

#: Columns that a catalogue must have (fixed by its publisher).
CATALOG_COLUMNS = ("Text#", "Title", "Authors", "Language", "Type")
#: Where the catalogue and the books are (fixed by their publisher and a mirror).
CATALOG = "https://www.gutenberg.org/cache/epub/feeds/pg_catalog.csv"
MIRROR = "https://mirror.cs.odu.edu/gutenberg-epub"
CATALOG_BYTES = 100_000_000
BOOK_BYTES = 20_000_000
AGENT = "Lexigraph/1.0"
TIMEOUT = 45
BOOK_SCHEMA = "id long, title string, author string, source string, download_url string, language string, words long, digest string"
BINARY = "path string, modificationTime timestamp, length long, content binary"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue in CSV; ``ValueError`` if columns are missing. A byte order
    mark before the first name is no part of it."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    if not set(CATALOG_COLUMNS) <= set(rows.columns):
        raise ValueError("The catalogue lacks columns.")
    return rows


def catalog_books(catalog: DataFrame, site: str = "https://www.gutenberg.org", mirror: str = MIRROR) -> DataFrame:
    """id, title, author, language, source and download_url of a catalogue."""
    number = F.col("`Text#`").cast("long")
    author: Column = F.coalesce(F.expr("nullif(Authors, '')"), F.lit("Unknown"))
    return catalog.select(
        number.alias("id"), F.col("Title").alias("title"), author.alias("author"), F.trim("Language").alias("language"),
        F.format_string("%s/ebooks/%d", F.lit(site), number).alias("source"), F.format_string("%s/%d/pg%d.txt", F.lit(mirror.rstrip("/")), number, number).alias("download_url"),
    )


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """Books of a folder of ``<id>.json`` and ``<id>.txt``, line ends kept."""
    meta = spark.read.schema(BOOK_SCHEMA).json(f"{folder}/*.json", multiLine=True)
    raw = spark.read.format("binaryFile").load(f"{folder}/*.txt")
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    return meta.join(raw.select(number.alias("id"), F.decode("content", "utf-8").alias("text")), "id")


def write_books(books: DataFrame, path: str) -> None:
    """Texts with their wrappers and metadata, as one table."""
    books.write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def bars(rows: DataFrame, label: str, value: str) -> DataFrame:
    """What a bar chart shows: label, value and the share of the largest."""
    top = rows.agg(F.max(value).alias("top"))
    return rows.crossJoin(F.broadcast(top)).select(F.col(label).alias("label"), F.col(value).alias("value"), F.when(F.col("top") > 0, F.col(value) / F.col("top")).otherwise(0.0).alias("share"))


def fetch(url: str, retries: int = 3, max_bytes: int = BOOK_BYTES, pause: Callable[[float], None] = time.sleep, opener=urllib.request.urlopen, timeout: float = TIMEOUT) -> bytes:
    """Download at most ``max_bytes``, waiting ``timeout`` seconds for an answer;
    403 and 404 are final at once, other failures and timeouts are tried again
    after 2 and 4 seconds."""
    asked = urllib.request.Request(url, headers={"User-Agent": AGENT})
    for attempt in range(1, retries + 1):
        try:
            with opener(asked, timeout=timeout) as response:
                data = response.read(max_bytes + 1)
            if len(data) > max_bytes:
                raise ValueError("The download is too large.")
            return data
        except urllib.error.HTTPError as error:
            if error.code in (403, 404) or attempt == retries:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == retries:
                raise
        pause(2.0**attempt)
    raise ValueError("no attempt was allowed")


def blank_to_null(column: str) -> Column:
    return F.expr(f"nullif(trim({column}), '')")


def strip_white(column: Column) -> Column:
    return F.regexp_replace(column, f"^[{WHITE}]+|[{WHITE}]+\\z", "")
