"""First-fit decreasing in randomised groups, by a tournament tree.

Each document's ids are cut into pieces of at most ``capacity``. Pieces are
counted and then dealt to groups of about ``GROUP_PIECES`` by a seeded hash of
doc_id, start, checksum and the piece's number in its task, so a hot source, a
run of copies, rows that all lack a doc_id or one enormous document spread over
all groups, and every group packs its pieces alone: longest first, each into the
first open sequence with room. The tournament tree holds the most room below
each node, so that first sequence is found in log2(n) steps.

Only (doc_id, start, length, checksum) travels, written once in the shared
folder; the ids stay behind. Null text
is empty and gives one piece with the end id; null doc_ids pack like others;
repeated rows are packed as often as they occur, with ties broken by doc_id,
start and checksum; an empty table gives no rows; extra columns are left aside.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .token_output import tokenized

#: Pieces of a group, on average.
GROUP_PIECES = 2048


class Tournament:
    """Leaves are sequences in the order of opening; a node has the most room
    of the leaves below it. Sequences not yet opened have full room."""

    def __init__(self, leaves: int, capacity: int):
        self.size = 1 << max(0, leaves - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def first_with(self, need: int) -> int:
        node, room = 1, self.room
        while node < self.size:
            node *= 2
            if room[node] < need:
                node += 1
        return node - self.size

    def take(self, leaf: int, need: int) -> int:
        """Fill ``need`` of the leaf; returns its room before that."""
        room, node = self.room, leaf + self.size
        had = room[node]
        room[node] = had - need
        node >>= 1
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node >>= 1
        return had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, longest first; equal ones in the
    order given."""
    order = np.argsort(-lengths, kind="stable")
    tree = Tournament(len(lengths), capacity)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        leaf = tree.first_with(need)
        sequence[i], offset[i] = leaf, capacity - tree.take(leaf, need)
    return sequence, offset


def cut(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each tokenized row, numbered within the task."""
    before = 0
    for batch in batches:
        ids, n = batch.column("ids"), batch.column("n_tokens").to_numpy(zero_copy_only=False)
        counts = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), counts)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
        length = np.minimum(n[row] - start, capacity)
        sums = np.empty(len(row), np.int64)
        now, raw = -1, b""
        for k, (i, s, size) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
            if i != now:
                now, raw = i, memoryview(ids[i].as_buffer())
            sums[k] = zlib.crc32(raw[4 * s : 4 * (s + size)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(sums), pa.array(n[row]), pa.array(np.arange(before, before + len(row)))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "turn"])
        before += len(row)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, seed: int = 17) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens and padded_tokens of every piece of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = tokenized(docs, vocabulary, end_id, "doc_id", after=lambda batches: cut(batches, capacity), schema="start long, length long, ids_crc32 long, doc_tokens long, turn long")
    pieces = saved(coded, "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    draw = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "turn")
    pieces = pieces.withColumn("group", F.pmod(draw, F.lit(groups)).cast("long")).drop("turn")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        local, rows["offset"] = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (rows["group"].to_numpy() << 32) | local
        rows["sequence_tokens"] = np.bincount(local, rows["length"]).astype(np.int64)[local]
        return rows.drop(columns="group")

    filled = pieces.groupBy("group").applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long")
    exact = F.expr("sequence_tokens & (sequence_tokens - 1)") == 0
    return filled.withColumn("padded_tokens", F.when(exact, F.col("sequence_tokens")).otherwise(F.lit(capacity).cast("long")))
