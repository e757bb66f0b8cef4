"""Word-level Wu-Manber search for benchmark windows.

Symbols are words (runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z
are lower-cased), patterns are windows of ``window`` consecutive item words; a
shorter item is one pattern of its own length, searched with tables of that
length. The shift table maps the hash of a block of two words to how far the
search may jump; where it says 0, the bucket of the block's hash names the
patterns with that suffix, whose hashes and then words are compared directly.

A batch's texts are cut into overlapping lanes of words that all jump at the
same time, each at its own pace; a lane's search is the sequential one.

Up to ``BLOCK_BYTES`` of benchmark text (its size is asked first) the tables go
along with the tasks, and one pass over the documents does it all. A larger
benchmark stays a table: what goes along is the shift tables (of fixed size,
whatever the benchmark's) and a fixed bitmap of window hashes; the pass gives each
row a key and its candidate places with their words, and these meet the table
of windows by suffix bucket and words in a join. Either way documents are scanned
once, every row is judged alone, and the results are the same.

Null text has no words; an item without words has no windows; repeated items
count once for each item_id; repeated documents each get a row; an empty
benchmark or table is fine; extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED_VALUES, MIX, free_name, hash_spans, mix, saved, slices, text_buffer, word_spans

WINDOW = 10
LANE = 256
TABLE_BITS = 16
#: Text bytes of a benchmark whose own tables go along with the tasks.
BLOCK_BYTES = 8 << 20
#: Bits of the bitmap of window hashes of a larger benchmark.
FILTER_BITS = 24

WORD = np.ones(256, bool)
WORD[:128] = False
WORD[48:58] = WORD[65:91] = WORD[97:123] = True


def blocks_of(words: np.ndarray) -> np.ndarray:
    """Hash of each pair of neighbouring words, at the second; the first has 0."""
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = mix(words[:-1] * MIX[0] + words[1:] * MIX[1])
    return out


def window_hash(words: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each place on."""
    with np.errstate(over="ignore"):
        total = np.full(len(first), m, np.uint64)
        for j in range(m):
            total += words[first + j] * MIX[8 + j % 32] + np.uint64(j // 32)
        return mix(total)


class Shifts:
    """The shift table for patterns of m words each: word hashes, row by row."""

    def __init__(self, m: int, patterns: np.ndarray):
        self.m = m
        self.mask = np.uint64((1 << TABLE_BITS) - 1)
        self.size = 2 if m > 1 else 1
        self.longest = m - self.size + 1
        self.shift = np.full(1 << TABLE_BITS, self.longest, np.int32)
        self.blocks = blocks_of(patterns.ravel()).reshape(-1, m) if m > 1 else patterns
        for j in range(self.size - 1, m):
            np.minimum.at(self.shift, (self.blocks[:, j] & self.mask).astype(np.int64), m - 1 - j)

    def stops(self, words: np.ndarray, blocks: np.ndarray, doc_first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places where the shift is 0 (a pattern may end there), and their
        blocks' hashes. All lanes jump at the same time."""
        m, lanes_at, lanes_to = self.m, [], []
        for s, e in zip(doc_first[:-1].tolist(), doc_first[1:].tolist()):
            if e - s >= m:
                at = np.arange(s + m - 1, e, LANE)
                lanes_at.append(at)
                lanes_to.append(np.minimum(at + LANE, e))
        if not lanes_at:
            return
        at, to = np.concatenate(lanes_at), np.concatenate(lanes_to)
        keys = blocks if m > 1 else words
        while len(at):
            key = keys[at]
            jump = self.shift[(key & self.mask).astype(np.int64)].astype(np.int64)
            stop = jump == 0
            if stop.any():
                yield at[stop], key[stop]
            at = at + np.maximum(jump, 1)
            going = at < to
            at, to = at[going], to[going]


class Matcher(Shifts):
    """Wu-Manber tables with buckets for patterns of m words each."""

    def __init__(self, patterns: list[list[bytes]]):
        self.patterns = patterns
        flat = b" ".join(w for p in patterns for w in p)
        data = np.frombuffer(flat, np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), WORD)
        self.words = hash_spans(data, starts, ends, FOLDED_VALUES).reshape(len(patterns), -1)
        super().__init__(self.words.shape[1], self.words)
        order = np.argsort(self.blocks[:, -1], kind="stable")
        self.suffix, self.bucket = self.blocks[order, -1], order

    def search(self, words: np.ndarray, blocks: np.ndarray, doc_first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, pattern) of all places whose word hashes agree."""
        for place, suffix in self.stops(words, blocks, doc_first):
            low, high = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
            count = high - low
            if not count.any():
                continue
            row = np.repeat(np.arange(len(place)), count)
            which = self.bucket[np.repeat(low, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]
            first = place[row] - self.m + 1
            same = np.ones(len(row), bool)
            for j in range(self.m):
                same &= words[first + j] == self.words[which, j]
            yield first[same], which[same]


def item_words(text: str | None) -> list[bytes]:
    data, offsets = text_buffer(pa.array([text or ""]))
    starts, ends, _ = word_spans(data, offsets, WORD)
    raw = data.tobytes()
    return [raw[s:e].lower() for s, e in zip(starts.tolist(), ends.tolist())]


class Searcher:
    """All patterns of the items, by length."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            words = item_words(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                owners.setdefault(tuple(words[i : i + size]), set()).add(item)
        by_length: dict[int, list] = {}
        for pattern in owners:
            by_length.setdefault(len(pattern), []).append(pattern)
        self.parts = [(Matcher([list(p) for p in ps]), [sorted(owners[p], key=str) for p in ps]) for _, ps in sorted(by_length.items())]

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
        """For each text: its number of words, the occurrences as (first word,
        words) and the items that occur."""
        starts, ends, first = word_spans(data, offsets, WORD)
        words = hash_spans(data, starts, ends, FOLDED_VALUES)
        blocks = blocks_of(words)
        n = len(offsets) - 1
        places: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[set] = [set() for _ in range(n)]
        for matcher, owners in self.parts:
            for at, which in matcher.search(words, blocks, first):
                docs = np.searchsorted(first, at, side="right") - 1
                for a, w, d in zip(at.tolist(), which.tolist(), docs.tolist()):
                    pattern = matcher.patterns[w]
                    if all(data[starts[a + j] : ends[a + j]].tobytes().lower() == p for j, p in enumerate(pattern)):
                        places[d].append((a - int(first[d]), len(pattern)))
                        items[d].update(owners[w])
        return np.diff(first), places, items


def covered(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (first, length) as disjoint (first, length), ascending."""
    out: list[list[int]] = []
    for s, size in sorted(places):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + size)
        else:
            out.append([s, s + size])
    return [(s, e - s) for s, e in out]


def carried(benchmark: DataFrame) -> list[tuple[int, str]] | None:
    """The items, if they are few enough to go along with the tasks."""
    told = benchmark.filter("length(text) > 0").select("item_id", "text")
    size = told.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return [(r.item_id, r.text) for r in told.collect()] if size <= BLOCK_BYTES else None


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_words, spans (array of first word and length, disjoint) and
    items (array of item_id, as strings in order) of every row of ``docs``."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_words long, spans array<struct<first:long,length:long>>, items array<string>"])
    items = carried(benchmark)
    if items is None:
        return find_by_join(docs.select(*dict.fromkeys([*keep, "text"])), benchmark, window, keep, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(items, window)
        for batch in batches:
            for part in slices(batch, "text"):
                n, places, owners = search.hits(*text_buffer(part.column("text")))
                spans = pa.array([[{"first": s, "length": k} for s, k in covered(p)] for p in places], SPANS)
                names = pa.array([sorted(map(str, o)) for o in owners], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n), spans, names], names=[*keep, "n_words", "spans", "items"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, columns as they are."""
    items = carried(benchmark)
    if items is None:
        found, met, key = candidates(docs, benchmark, window)
        hit = saved(met.select(F.col("key").alias(key)).distinct(), "contaminated")
        return found.join(hit, key, "left_anti").select(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(items, window)
        for batch in batches:
            for part in slices(batch, "text"):
                _, places, _ = search.hits(*text_buffer(part.column("text")))
                yield part.filter(pa.array([not p for p in places], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


WINDOWS, SHIFTS, BITS = 0, 1, 2


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """kind WINDOWS: an item's window of ``size`` words with its hash; SHIFTS:
    an entry of a task's shift table for size (hash: slot, value: shift); BITS:
    64 bits of its bitmap (hash: slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "size", "hash", "value", "words", "item"]
        for batch in batches:
            for part in slices(batch, "text"):
                items = list(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist()))
                for matcher, owners in Searcher(items, window).parts:
                    m, n = matcher.m, len(matcher.patterns)
                    hashes = window_hash(matcher.words.ravel(), np.arange(n) * m, m)
                    words = [b" ".join(p).decode() for p in matcher.patterns]
                    row = [i for i, own in enumerate(owners) for _ in own]
                    yield pa.RecordBatch.from_arrays([pa.array([WINDOWS] * len(row), pa.int32()), pa.array([m] * len(row), pa.int32()), pa.array(hashes[row].view(np.int64)), pa.nulls(len(row), pa.int64()), pa.array([words[i] for i in row], pa.string()), pa.array([str(x) for own in owners for x in own], pa.string())], names=names)
                    slot = np.flatnonzero(matcher.shift < matcher.longest)
                    place = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    bits = np.zeros((1 << FILTER_BITS) >> 6, np.uint64)
                    np.bitwise_or.at(bits, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
                    set_ = np.flatnonzero(bits)
                    for kind, at, value in ((SHIFTS, slot, matcher.shift[slot].astype(np.int64)), (BITS, set_, bits[set_].view(np.int64))):
                        k = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.int32()), pa.array([m] * k, pa.int32()), pa.array(at), pa.array(value), pa.nulls(k, pa.string()), pa.nulls(k, pa.string())], names=names)

    told = benchmark.filter("length(text) > 0").select("item_id", "text")
    return told.mapInArrow(run, "kind int, size int, hash long, value long, words string, item string")


def candidates(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, str]:
    """All rows of ``docs`` with a key, n_words and candidates; key, first,
    size and item of every occurrence; and the key's name among the columns."""
    table = saved(windows_of(benchmark, window).distinct(), "windows")
    # Bounded by the sizes of the tables: a shift for each slot and size, and the bitmap.
    shifts: dict[int, np.ndarray] = {}
    for r in table.filter(F.col("kind") == SHIFTS).groupBy("size", "hash").agg(F.min("value").alias("value")).toLocalIterator():
        shifts.setdefault(r["size"], np.full(1 << TABLE_BITS, Shifts(r["size"], np.zeros((0, r["size"]), np.uint64)).longest, np.int32))[r["hash"]] = r["value"]
    bits = np.zeros((1 << FILTER_BITS) >> 6, np.int64)
    for r in table.filter(F.col("kind") == BITS).groupBy("hash").agg(F.expr("bit_or(value)").alias("value")).toLocalIterator():
        bits[r["hash"]] = r["value"]
    bits = bits.view(np.uint64)
    own = [free_name(docs, c) for c in ("key", "n_words", "candidates")]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int32()), ("hash", pa.int64()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = []
        for m in sorted(shifts):
            searchers.append(Shifts(m, np.zeros((0, m), np.uint64)))
            searchers[-1].shift = shifts[m]
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                starts, ends, first = word_spans(data, offsets, WORD)
                words = hash_spans(data, starts, ends, FOLDED_VALUES)
                blocks, found = blocks_of(words), [[] for _ in range(part.num_rows)]
                for s in searchers:
                    for place, _ in s.stops(words, blocks, first):
                        at = place - s.m + 1
                        h = window_hash(words, at, s.m)
                        slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        may = np.flatnonzero(bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
                        for a, x, d in zip(at[may].tolist(), h[may].view(np.int64).tolist(), (np.searchsorted(first, at[may], side="right") - 1).tolist()):
                            said = b" ".join(data[starts[a + j] : ends[a + j]].tobytes().lower() for j in range(s.m)).decode()
                            found[d].append({"first": a - int(first[d]), "size": s.m, "hash": x, "words": said})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.arange(key, key + part.num_rows)), pa.array(np.diff(first)), pa.array(found, kind)], names=[*part.schema.names, *own])
                key += part.num_rows

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{own[0]} long, {own[1]} long, {own[2]} array<struct<first:long,size:int,hash:long,words:string>>"])
    found = saved(docs.mapInArrow(run, schema), "candidates")
    places = found.filter(F.size(own[2]) > 0).select(F.col(own[0]).alias("key"), F.explode(own[2]).alias("c")).select("key", "c.*")
    # Windows that occur, once each, meet the benchmark's; then they are few for the hot ones' many places.
    occurring = saved(places.select("size", "hash", "words").distinct().join(table.filter(F.col("kind") == WINDOWS).select("size", "hash", "words", "item"), ["size", "hash", "words"]), "occurring")
    return found, places.join(occurring, ["size", "hash", "words"]).select("key", "first", "size", "item"), own[0]


def find_by_join(docs: DataFrame, benchmark: DataFrame, window: int, keep: tuple[str, ...], schema: str) -> DataFrame:
    """``find_contamination`` for a benchmark that stays a table."""
    own_words = free_name(docs, "n_words")
    found, met, key = candidates(docs, benchmark, window)
    met = saved(met, "occurrences")
    spans = met.select("key", "first", "size").distinct().groupBy("key").agg(F.collect_list(F.struct("first", "size")).alias("found_places"))
    items = met.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("found_items"))
    hits = spans.join(items, "key").withColumnRenamed("key", key)
    rows = found.select(*keep, F.col(own_words).alias("found_words"), key).join(hits, key, "left").select(*keep, "found_words", "found_places", "found_items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([[{"first": s, "length": k} for s, k in covered([(x["first"], x["size"]) for x in p or []])] for p in batch.column("found_places").to_pylist()], SPANS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("found_words"), spans, pa.array([x or [] for x in batch.column("found_items").to_pylist()], pa.list_(pa.string()))], names=[*keep, "n_words", "spans", "items"])

    return rows.mapInArrow(run, schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The counts and digest of each document's contamination."""
    hits = find_contamination(docs, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
