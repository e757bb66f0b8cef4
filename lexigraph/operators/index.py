"""The inverted index: postings, vocabulary and lengths.

One explode and one aggregate with map-side partial counts make the postings;
the vocabulary is a by-product. Words are natural keys, so no surrogate ids
have to be dealt out in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def postings(books: DataFrame, content: str = "content") -> DataFrame:
    """word, book_id and count of every word of every book."""
    words = books.select(F.col("id").alias("book_id"), F.explode(T.tokens(F.col(content))).alias("word"))
    return words.groupBy("word", "book_id").agg(F.count("*").alias("count"))


def vocabulary(index: DataFrame) -> DataFrame:
    return index.select("word").distinct()


def lengths(index: DataFrame) -> DataFrame:
    """book_id, words (occurrences) and distinct_words of each book."""
    return index.groupBy("book_id").agg(F.sum("count").alias("words"), F.count("*").alias("distinct_words"))


def laid_out(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """Postings in files by range of words, sorted by word and book, so that
    Parquet's statistics find a word or a range of first characters."""
    ranged = index.repartitionByRange(partitions, "word") if partitions else index.repartitionByRange("word")
    return ranged.sortWithinPartitions("word", "book_id")


def matching_words(words: DataFrame, condition: Column) -> DataFrame:
    return words.filter(condition).select("word").distinct()


def occurrences(index: DataFrame, words: DataFrame) -> DataFrame:
    """book_id and the number of occurrences of any of ``words``."""
    return index.join(words, "word", "left_semi").groupBy("book_id").agg(F.sum("count").alias("occurrences"))
