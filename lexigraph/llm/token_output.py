"""Token ids in binary segments with Elias-Fano document boundaries.

A segment is one self-contained run of bytes: magic ``LXTK``, a header of
little-endian unsigned 64-bit numbers (version, documents, ids, first id's
place in its range, width of an id in bytes), the documents' ids as int64, the
Elias-Fano boundaries and the concatenated token ids. Boundaries b_1..b_n (the
end of each document, relative to the segment) are stored as l low bits each,
l = floor(log2(ids / documents)), and a bit vector with a one at
(b_i >> l) + i; a directory of every 256th one's place makes ``select`` look at
one small stretch. That is about 2 + l bits a document instead of 64, and all
reading of boundaries goes through ``select``.

The output is dealt into ranges of ascending doc_id, and each range into
segments of a bounded number of ids. Segments lie in a table of one binary
column in the shared folder, so that Spark's committer decides which task's
bytes count, whatever is lost meanwhile; its row groups are small, so a reader
holds few segments at once. A second table has each range's first place.

Documents are in ascending doc_id order within and across segments. A null text
is an empty one; an empty document has just its end id; repeated rows stay;
rows of equal doc_id go by their ids' checksum and number, and where a doc_id
(or null) fills several ranges' share of the table they are dealt to several
ranges by that checksum; null doc_ids come first. Extra columns are left aside,
and an empty table makes no segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, release, scratch, slices
from .tokens import encoder

MAGIC = b"LXTK"
VERSION = 2
STRIDE = 256
#: Ids in a segment before the next begins (a longer document goes alone).
SEGMENT_IDS = 1 << 18
#: Segments of a row group of the stored table, at most.
GROUP_SEGMENTS = 4
NULL_ID = -(2**63)
#: Text bytes that are encoded at once.
STEP = 1 << 20
#: Documents whose boundaries and checksums are read at once.
READ_DOCS = 16 * STRIDE


class EliasFano:
    """A non-decreasing sequence with select, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::STRIDE].astype(np.uint32))

    def select(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last`` (exclusive): finds their ones from the
        directory's nearest places, and their low bits by place."""
        index = np.arange(first, last)
        if not len(index):
            return index
        ones = np.empty(len(index), np.int64)
        for block in range(first // STRIDE, (last - 1) // STRIDE + 1):
            begin = int(self.places[block])
            stop = int(self.places[block + 1]) if block + 1 < len(self.places) else 8 * len(self.high)
            found = np.flatnonzero(np.unpackbits(self.high[begin >> 3 : (stop + 7) >> 3], bitorder="little")[begin & 7 :]) + begin
            low, high = max(first, block * STRIDE), min(last, (block + 1) * STRIDE)
            ones[low - first : high - first] = found[low - block * STRIDE : high - block * STRIDE]
        values = (ones - index) << self.low_bits
        if self.low_bits:
            bits = index[:, None] * self.low_bits + np.arange(self.low_bits)
            values += ((self.low[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return values

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8").tobytes()
        return head + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview) -> tuple["EliasFano", int]:
        n, low_bits, low, high = np.frombuffer(data[:32], "<u8").tolist()
        at = 32
        lows = np.frombuffer(data[at : at + low], np.uint8)
        at += low
        highs = np.frombuffer(data[at : at + high], np.uint8)
        at += high
        marks = -(-n // STRIDE) * 4
        return cls(n, low_bits, lows, highs, np.frombuffer(data[at : at + marks], "<u4")), at + marks


def write_segment(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, place: int = 0) -> bytes:
    head = np.array([VERSION, len(doc_ids), len(ids), place, ids.dtype.itemsize], "<u8").tobytes()
    return b"".join((MAGIC, head, doc_ids.astype("<i8").tobytes(), EliasFano.of(ends).to_bytes(), ids.tobytes()))


def read_segment(data) -> tuple[np.ndarray, EliasFano, np.ndarray, int]:
    """Doc ids, boundaries, token ids and place of a segment, without a copy."""
    view = memoryview(data)
    if bytes(view[:4]) != MAGIC:
        raise ValueError("not a token segment")
    version, docs, n, place, width = np.frombuffer(view, "<u8", 5, 4).tolist()
    if version != VERSION:
        raise ValueError(f"segment version {version}")
    view = view[44:]
    doc_ids = np.frombuffer(view, "<i8", docs)
    bounds, used = EliasFano.read(view[docs * 8 :])
    ids = np.frombuffer(view, f"<u{width}", n, docs * 8 + used)
    return doc_ids, bounds, ids, place


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, *keep: str, after=None, schema: str = "n_tokens long, ids binary", narrow: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens (with the end id) and ids (little-endian
    unsigned 32-bit, with the end id) of each row's whole text. ``after`` turns
    these batches into others in the same task, of ``keep`` and ``schema``.
    ``narrow``: ids take 16 bits where the vocabulary allows it."""
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        code = encoder(vocabulary)
        width = code.width if narrow and end_id < 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            for part in slices(batch, "text", STEP):
                ids, at = code.encode(part.column("text"))
                raw = ids.astype(f"<u{width}").tobytes()
                rows = [raw[width * s : width * e] + end for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(at) + 1), pa.array(rows, pa.binary())], names=[*keep, "n_tokens", "ids"])
            release()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), schema])
    return docs.select(*keep, "text").mapInArrow((lambda batches: after(run(batches))) if after else run, schema)


def id_bounds(docs: DataFrame, column: str, n: int) -> np.ndarray:
    """Bounds that deal ``column`` into n about equal ranges: n - 1 numbers,
    ascending; a frequent value is several of them."""
    if n < 2:
        return np.zeros(0, np.int64)
    marks = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx(column, marks, max(10_000, 20 * n))).first()[0]
    return np.sort(np.array(found or [], np.int64))


def range_of(bounds: np.ndarray, doc_ids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The range of each row. An id that is several bounds has the ranges
    between them to itself, dealt by the 32-bit checksum."""
    low, high = np.searchsorted(bounds, doc_ids, "left"), np.searchsorted(bounds, doc_ids, "right")
    own = high - low - 1
    return np.where(own > 0, low + 1 + (sums * np.maximum(own, 1) >> 32), low)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> str:
    """Write segments of all ``docs`` (doc_id, text); returns their folder.

    Ids travel once, dealt by ranges of doc_id. The number of ranges follows
    spark.sql.shuffle.partitions, so each holds a bounded share of the input.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    bounds = id_bounds(docs, "doc_id", 4 * partitions(spark))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy()
            sums = np.fromiter((zlib.crc32(x.as_buffer()) for x in batch.column("ids")), np.int64, len(doc_ids))
            place = range_of(bounds, doc_ids, sums).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(place)], names=[*batch.schema.names, "sum", "range"])

    coded = tokenized(docs, vocabulary, end_id, "doc_id", after=ranged, schema="n_tokens long, ids binary, sum long, range int", narrow=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, docs_, ends, total, part, place = None, [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), f"<u{sum(map(len, ids)) // total}")
            data = write_segment(np.array(docs_, np.int64), np.array(ends, np.int64), flat, place)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part], pa.int32()), pa.array([len(docs_)], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], names=["range", "part", "n_docs", "n_ids", "segment"])

        for batch in batches:
            raws = batch.column("ids")
            for i, (r, d, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "n_tokens")))):
                if docs_ and (r != now or total + n > SEGMENT_IDS):
                    yield flush()
                    part, place = (part + 1, place + total) if r == now else (0, 0)
                    ids, docs_, ends, total = [], [], [], 0
                now = r
                ids.append(raws[i].as_py())
                docs_.append(d)
                total += n
                ends.append(total)
        if docs_:
            yield flush()

    dealt = coded.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "doc_id", "sum", "n_tokens")
    packed = dealt.select("range", "doc_id", "n_tokens", "ids").mapInArrow(pack, "range int, part int, n_docs long, n_ids long, segment binary")
    groups = {"parquet.block.row.count.limit": GROUP_SEGMENTS, "parquet.page.row.count.limit": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
    packed.write.options(**groups).parquet(f"{path}/segments")
    # A row for each range, of which there are 4 times the shuffle partitions at most.
    held = spark.read.parquet(f"{path}/segments").groupBy("range").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("range")) - F.col("n_ids")
    held.select("range", before.alias("first")).coalesce(1).write.parquet(f"{path}/ranges")
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32
    of each document, all from the segments' bytes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("segment")
            for i, r in enumerate(batch.column("range").to_pylist()):
                doc_ids, bounds, ids, place = read_segment(cells[i].as_buffer())
                at = 0
                for first in range(0, len(doc_ids), READ_DOCS):
                    own = doc_ids[first : first + READ_DOCS]
                    ends = bounds.select(first, first + len(own))
                    starts = np.concatenate([[at], ends[:-1]])
                    raw = memoryview(ids[at : ends[-1]].astype("<u4")).cast("B")
                    sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((starts - at).tolist(), (ends - at).tolist())]
                    at = int(ends[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r, np.int32)), pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(starts + place), pa.array(ends - starts), pa.array(sums, pa.int64())], names=["range", "doc_id", "start", "n_tokens", "ids_crc32"])
            release()

    stored = spark.read.schema("range int, segment binary").parquet(f"{path}/segments")
    read = stored.mapInArrow(unpack, "range int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # Bounded by 4 times the shuffle partitions; only narrow rows meet it.
    first = F.broadcast(spark.read.schema("range int, first long").parquet(f"{path}/ranges"))
    return read.join(first, "range").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
