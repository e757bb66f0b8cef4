"""Proportional stratified interleaving into shards, by DataFrame functions.

Rows are put in a seeded random order within each source; the r-th of a
source's n rows gets the fractional rank (r - 1/2) / n; all rows are sorted by
it, and that order is cut into shards whose row counts differ by at most one.
Every stretch of the order, so every shard, then holds each source in its share
of the whole.

No window covers a source or the table. A rank is the number of rows in the
earlier slices of the source's hash range plus a row number within the slice;
a place is the number of rows in the earlier slices of [0, 1) plus a row number
within the slice. The slice counts are aggregates with map-side partial sums,
summed up in two levels, so a source with a third of all rows is dealt over as
many slices as the rest. The order's hash is the MD5 of seed, doc_id, checksum
and size, so rows that lack a doc_id or share one are dealt out too, but for
those equal in text as well, which lie in one slice.

Null text has size 8 and checksum 0; a null source is a source of its own; ties
of the random order go by doc_id, size and checksum (nulls first); repeated rows
each get a slot; an empty table gives no rows; extra columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

#: Rows that one window slice holds on average, at most.
SLICE_ROWS = 8192
#: Slices whose counts are summed up together.
SLICES = 4096
#: Hexadecimal digits of the order's hash.
DIGITS = 13


def order_hash(seed: int) -> Column:
    """0 to 16 ** DIGITS - 1, from seed, doc_id, checksum and size."""
    said = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(said), 1, DIGITS), 16, 10).cast("long")


def before_each(counts: DataFrame) -> DataFrame:
    """group, piece, ``before`` (the sum of n in the group's earlier pieces) and
    ``of_group`` (its whole sum), from group, piece and n."""
    counts = counts.withColumn("block", F.floor(F.col("piece") / SLICES))
    earlier = lambda part, by: F.coalesce(F.sum("n").over(part.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("group")
    blocks = counts.groupBy("group", "block").agg(F.sum("n").alias("n")).select(F.col("group").alias("g"), F.col("block").alias("b"), earlier(whole, "block").alias("base"), F.sum("n").over(whole).alias("of_group"))
    inner = counts.withColumn("inside", earlier(Window.partitionBy("group", "block"), "piece"))
    return inner.join(blocks, F.expr("group <=> g and block = b")).select("group", "piece", (F.col("base") + F.col("inside")).alias("before"), "of_group")


def slots(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source and
    fraction of all ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # Texts are read once; a few numbers of each row go on.
    rows = saved(rows.withColumn("order_hash", order_hash(seed)), "sizes")
    total = rows.count()
    pieces = max(1, 4 * partitions(spark), -(-total // SLICE_ROWS))
    # A slice is an equal part of the hash's range.
    rows = rows.withColumn("piece", F.floor(F.col("order_hash") / F.lit(float(16**DIGITS)) * pieces).cast("long"))
    counts = saved(before_each(rows.groupBy(F.col("source").alias("group"), "piece").agg(F.count("*").alias("n"))), "source-slices")
    here = Window.partitionBy("source", "piece").orderBy("order_hash", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("r", F.row_number().over(here)).alias("a").join(
        counts.alias("b"), F.expr("a.source <=> b.group and a.piece = b.piece")
    ).select("a.doc_id", "a.source", "a.size", "a.text_crc32", "a.order_hash", ((F.col("a.r") + F.col("b.before") - 0.5) / F.col("b.of_group")).alias("fraction"))
    ranked = saved(ranked, "ranked").withColumn("piece", F.floor(F.col("fraction") * pieces).cast("long"))

    cuts = saved(before_each(ranked.groupBy(F.lit(0).alias("group"), "piece").agg(F.count("*").alias("n"))).select("piece", "before"), "cuts")
    here = Window.partitionBy("piece").orderBy("fraction", "source", "order_hash", "doc_id", "size", "text_crc32")
    placed = ranked.withColumn("r", F.row_number().over(here)).join(cuts, "piece").withColumn("place", F.col("r") - 1 + F.col("before"))
    shard = F.expr(f"(place * {shards}L) div {max(total, 1)}L")
    begin = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("place") - begin).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source", "fraction"
    )
