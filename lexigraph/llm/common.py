"""Shared pieces: table access, shared scratch space, batch slicing and
vectorised word scanning over Arrow string buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step holds; longer single texts go alone.
STEP_BYTES = 4 << 20
#: Bytes of an Arrow batch between the JVM and Python, about.
BATCH_BYTES = 8 << 20
#: Bytes that one hashing step covers; words are never cut.
HASH_BYTES = 1 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, however long the texts are, unless the
    session sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "-1"):  # Spark's default, and no bound
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share,
    or under the checkpoint folder that the session was given later. Without
    one only a session on one machine goes on, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="lexigraph-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    ends here, and a lost executor costs at most the tasks that were running."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    bounded(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or the like that is no column of ``docs``."""
    while name in docs.columns:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges whose ``column`` holds about ``limit`` bytes."""
    n = batch.num_rows
    if n == 0:
        return
    offsets = byte_offsets(batch.column(column))
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def byte_offsets(column: pa.Array) -> np.ndarray:
    """int64 offsets (n + 1) into the column's data buffer."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffer = column.buffers()[1]
    if buffer is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffer, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    offsets = byte_offsets(column)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside[byte]``, never across two texts.

    Returns starts, ends and, for each text, the index of its first word
    (length: texts + 1).
    """
    mark = inside[data]
    if not len(mark):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    last = mark.copy()
    last[:-1] &= ~mark[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(mark))]
    first[cuts] = mark[cuts]
    last[cuts - 1] = mark[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd-power polynomial over random byte values: fixed by the seed.
BYTE_VALUES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = np.uint64(int(_rng.integers(1, 2**63)) * 2 + 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
MIX = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, size: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < size:
        size = max(size, HASH_BYTES + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                top = have[done - 1] * base
                have[done : done + step] = have[:step] * top
                done += step
        _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hashes of the byte spans, which must ascend and not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + HASH_BYTES, side="right")))
            size = int(ends[to - 1] - base)
            total = np.empty(size + 1, np.uint64)
            total[0] = 0
            np.cumsum(values[data[base : base + size]] * _power_table("up", BASE, size + 1)[:size], out=total[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = (total[e] - total[s]) * _power_table("down", INVERSE, size + 1)[s] + (e - s).astype(np.uint64) * MIX[63]
            at = to
    return mix(out)


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``lengths``: the run of each item, and its place in the run."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    run = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return run, np.arange(total) - first[run]


def release() -> None:
    """Give memory that is free back to the system, between heavy steps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
