"""From raw documents to accepted books: filters, states and exact duplicates.

Input: id, text and, if there, title, author and source. Every rule is a column
or an aggregate over digests, whose groups of copies meet as narrow rows with
partial sums; no window holds texts, and nothing is looped over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.storage import saved

MIN_WORDS = 10_000
#: The twelve books of a first installation (fixed values).
SEED_IDS = (11, 74, 76, 84, 98, 174, 345, 1260, 1342, 1400, 1661, 2701)
#: States that a later run doesn't try again.
TERMINAL = ("accepted", "short", "duplicate", "missing")


class ShortBook(ValueError):
    """A book has fewer words than asked for."""


def catalog_candidates(catalog: DataFrame, language: str = "en") -> DataFrame:
    """English texts of a catalogue."""
    return catalog.filter((F.col("Type") == "Text") & (T.strip(F.col("Language")) == language))


def catalog_order(catalog: DataFrame, seeds: tuple[int, ...] = SEED_IDS) -> list[Column]:
    """Sort keys: seeds first, then by number."""
    number = F.col("`Text#`").cast("long")
    return [(~number.isin(*seeds)).cast("int"), number]


def without(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def unfinished(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Rows that no earlier run brought to a terminal state; errors are retried."""
    return without(rows, states.filter(F.col("status").isin(*TERMINAL)), "id")


def cleaned(rows: DataFrame) -> DataFrame:
    """Adds content, words (number of words) and digest."""
    content = T.clean_text(F.coalesce(F.col("text"), F.lit("")))
    out = rows.withColumn("content", content)
    return out.withColumn("words", F.size(T.tokens(F.col("content"))).cast("long")).withColumn("digest", T.digest(F.col("content")))


def statuses(rows: DataFrame, min_words: int = MIN_WORDS, known: DataFrame | None = None, order: list[Column] | None = None, too_large: int = 20_000_000) -> DataFrame:
    """id, status, words and digest: error (too large, or a web page), short
    (checked before duplicates), duplicate (of a known book's digest or of an
    accepted row earlier in ``order``), accepted. Other columns but the text are
    kept."""
    order = order or [F.col("id")]
    error = F.coalesce(T.too_large(F.col("text"), too_large) | T.is_html(F.col("text")), F.lit(True))
    out = cleaned(rows).withColumn("bad", error).drop("text", "content")
    # Texts are read once; the number tells equal rows apart.
    out = saved(out.withColumn("fit", ~F.col("bad") & (F.col("words") >= min_words)).withColumn("turn", F.monotonically_increasing_id()), "judged")
    first = out.filter("fit").groupBy("digest").agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), "turn"))["turn"].alias("turn"))
    if known is not None:
        first = without(first, known, "digest")
    out = out.join(first.select("turn", F.lit(True).alias("first")), "turn", "left")
    status = F.when(F.col("bad"), "error").when(~F.col("fit"), "short").when(F.col("first"), "accepted").otherwise("duplicate")
    return out.withColumn("status", status).drop("bad", "fit", "first", "turn")


def first_accepted(rows: DataFrame, target: int, order: list[str]) -> DataFrame:
    """The first ``target`` accepted rows; a top-k, not a window over all."""
    return rows.filter(F.col("status") == "accepted").orderBy(*order).limit(target)


def staged(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The rows with cleaned texts, written once: turn (a number of the row), id,
    title, author, source, digest and content. Known ids are left out
    without a look at their text."""
    if known is not None:
        rows = without(rows, known, "id")
    content = T.clean_text(F.coalesce(F.col("text"), F.lit("")))
    optional = lambda name, missing: F.coalesce(F.col(name), F.lit(missing)) if name in rows.columns else F.lit(missing)
    out = rows.select("id", optional("title", "").alias("title"), optional("author", "Unknown").alias("author"), optional("source", "").alias("source"), content.alias("content"))
    return saved(out.select(F.monotonically_increasing_id().alias("turn"), "id", "title", "author", "source", T.digest(F.col("content")).alias("digest"), "content"), "staged")


def accepted(stage: DataFrame, counts: DataFrame, min_words: int, known: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """turn and the columns of a book of those staged rows that are books: with
    enough words (``counts`` has turn, word and count), new by content and the
    first of it by id; of rows of one id the one with the least digest. ``strict``
    raises for the first short one instead of leaving it out."""
    lengths = counts.groupBy("turn").agg(F.sum("count").alias("words"))
    found = stage.withColumn("excerpt", T.excerpt(F.col("content"))).drop("content").join(lengths, "turn", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    if strict:
        short = found.filter(F.col("words") < min_words).select("id", "words").orderBy("id").first()
        if short:
            raise ShortBook(f"Book {short['id']} has {short['words']} words, fewer than {min_words}.")
    found = found.filter(F.col("words") >= min_words)
    if known is not None:
        found = without(found, known, "digest")
    one = found.groupBy("id").agg(F.min(F.struct("digest", "turn")).alias("x"))
    first = one.groupBy("x.digest").agg(F.min(F.struct("id", "x.turn"))["turn"].alias("turn"))
    return found.join(first.select("turn"), "turn").select("turn", "id", "title", "author", "source", "words", "digest", "excerpt")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each row with their counts. Rows of one word lie together, which
    makes files and later exchanges half as large."""
    for batch in batches:
        lists, turn = batch.column("words"), batch.column("turn").to_numpy()
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        key, count = np.unique(coded.indices.to_numpy().astype(np.int64) * len(lists) + row, return_counts=True)
        if len(key):
            words = coded.dictionary.take(pa.array(key // len(lists)))
            yield pa.RecordBatch.from_arrays([pa.array(turn[key % len(lists)]), words, pa.array(count.astype(np.int64))], names=["turn", "word", "count"])


def word_counts(stage: DataFrame) -> DataFrame:
    """turn, word and count of every word of every staged row, written once. A
    row's words are in one place, so nothing is exchanged."""
    words = stage.select("turn", T.tokens(F.col("content")).alias("words"))
    return saved(words.mapInArrow(_counted, "turn long, word string, count long"), "counts")


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct words and their counts in place of its words."""
    for batch in batches:
        lists = batch.column("words")
        coded = lists.flatten().dictionary_encode()
        wide = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        key, count = np.unique(row * wide + coded.indices.to_numpy(), return_counts=True)
        places = np.searchsorted(key, np.arange(len(lists) + 1) * wide).astype(np.int32)
        words = coded.dictionary.take(pa.array(key % wide))
        total = np.bincount(row, minlength=len(lists)).astype(np.int64)
        made = {"words": pa.ListArray.from_arrays(places, words), "counts": pa.ListArray.from_arrays(places, pa.array(count.astype(np.int64))), "total": pa.array(total)}
        names = [n for n in batch.schema.names if n != "words"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made.values()], names=[*names, *made])


def bagged(rows: DataFrame) -> DataFrame:
    """The rows (id, text and more) without their texts, one row for each, written once: turn (a number
    of the row), digest, distinct words, their counts and total. Neither the texts are written
    nor a row's words dealt out."""
    content = T.clean_text(F.coalesce(F.col("text"), F.lit("")))
    out = rows.withColumn("content", content).withColumn("turn", F.monotonically_increasing_id())
    out = out.withColumn("digest", T.digest(F.col("content"))).withColumn("words", T.tokens(F.col("content"))).drop("text", "content")
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name != "words")
    return saved(out.mapInArrow(_bagged, f"{others}, words array<string>, counts array<bigint>, total bigint"), "bagged")


def first_copies(bags: DataFrame, min_words: int = 1) -> DataFrame:
    """The rows of ``bagged`` that are books, by the rules of ``accepted``."""
    found = bags.filter(F.col("total") >= min_words)
    one = found.groupBy("id").agg(F.min(F.struct("digest", "turn")).alias("x"))
    return found.join(one.groupBy("x.digest").agg(F.min(F.struct("id", "x.turn"))["turn"].alias("turn")).select("turn"), "turn")


def refreshed_digests(books: DataFrame, texts: DataFrame) -> DataFrame:
    """Books with the digests of their present texts, where those are given."""
    fresh = texts.select("id", T.digest(T.clean_text(F.col("text"))).alias("fresh"))
    return books.join(fresh, "id", "left").withColumn("digest", F.coalesce("fresh", "digest")).drop("fresh").select(books.columns)
