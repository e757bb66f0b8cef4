"""Exact set-similarity self-join on word shingles, heavy and light sets apart.

A document's set holds its distinct 5-word shingles as 64-bit hashes (a text of
1 to 4 words: that sequence as one; an empty one: nothing). Two documents link
when 100 * |A & B| >= 75 * |A | B|. Linked sets of size s share at least
ceil(3s/4) elements, so under one global order each holds a common element
among its first floor(s/4) + 1, and two common ones among its first
floor(s/4) + 2. The order is by document frequency, the frequent last.

1. One pass over the texts hashes every set; equal sets are one class from then
   on, named by 64 bits of their digest. The pass also finds the hot shingles,
   those in at least one of 1,000 sets; there can be at most 1,000 times the
   mean set size of them, whatever the input's size.
2. A second pass scatters all other shingles, packed, to ranges of their hash.
   Where a shingle has company its class learns so, with the frequency. A class
   whose unshared shingles fill its prefix can have no partner, which excludes
   nearly everything but copies; hot shingles never travel, they come last.
3. For what remains, size-aware: a light set (size up to the boundary) enters
   every 2-subset of its longer prefix into an index of subsets; a heavy set's
   prefix elements are inverted lists, into which light sets large enough for a
   heavy partner post as well. The boundary minimises the estimated cost: the number of
   subsets below it, and above it list entries with a share of the lists'
   lengths, the part that is compared.
4. Lists aren't expanded into all pairs. Classes with the same longest list lie
   together in blocks of bounded size, where inverted lists of all their shared
   shingles give the exact components without a row for each pair. Then lists
   that still hold several components yield one drawn pair for each, which
   joins what many links connect; and last all pairs of different components
   and blocks, so that no link between components is lost; they meet by bands of
   sizes, as linked sets are alike in size.
5. Pairs pass the positional bound (what two sets can share behind their first
   common element) and are verified on the sets' shared shingles, which are all
   that can intersect; a set travels once for each part of a pair of blocks, of
   which those with many pairs have several.

Components come from min-label propagation with pointer jumping over tables in
the shared folder. Null text has no words; null doc_ids take part but name no
component; repeated rows are copies; an empty table gives no rows; extra
columns are left aside. ``one_of_each`` keeps, of each component, one row: of the
least doc_id (one without doc_id only where no row has one), of its texts the one
with the least hash, of equal texts the one with the least other columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDED_VALUES, MIX, free_name, hash_spans, mix, partitions, release, saved, slices, spread, text_buffer, word_spans

SHINGLE = 5
#: Similarity in percent.
PERCENT = 75
#: A shingle is hot in at least one of so many sets, and at least HOT_LEAST.
HOT_SHARE = 1000
HOT_LEAST = 64
#: What share of a list's members an entry is compared with, in rows' cost.
COMPARED = 0.02
#: Shingles of the sets in a block, and sets in it, about.
BLOCK_SHINGLES = 2_000_000
BLOCK_SETS = 512
#: Pairs in a part of a tile, about.
TILE_PAIRS = 512
#: Shingles of a hash range, about, where that makes more ranges than there are shuffle partitions.
RANGE_SHINGLES = 8_000_000

WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_spans(data, offsets, WORD)
    w = hash_spans(data, starts, ends, FOLDED_VALUES)
    n = len(w)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            full += w[k : n - SHINGLE + 1 + k] * MIX[k]
        full = mix(full)
        out = []
        for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
            if e - s >= SHINGLE:
                out.append(np.unique(full[s : e - SHINGLE + 1]))
            elif e > s:
                out.append(mix((w[s:e] * MIX[: e - s]).sum(dtype=np.uint64, keepdims=True) + MIX[40 + e - s]))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def class_name(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=8).digest(), "little")


def profile(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, class (name), size and text hash (print) of each row;
    kind 1: shingles that may be hot (name) and how many classes of the task
    hold them (size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, seen, sets = [], [], set(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                own = shingle_sets(part.column("text"))
                names = np.array([class_name(x) for x in own], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(own), np.int32)), part.column("doc_id"), pa.array(names.view(np.int64)), pa.array(np.fromiter(map(len, own), np.int64, len(own))), part.column("print")], names=["kind", "doc_id", "name", "size", "print"]
                )
                _, once = np.unique(names, return_index=True)
                fresh = [i for i in once.tolist() if int(names[i]) not in seen and len(own[i])]
                if len(seen) < 1 << 17:
                    seen.update(int(names[i]) for i in fresh)
                sets += len(fresh)
                if fresh:
                    h, c = np.unique(np.concatenate([own[i] for i in fresh]), return_counts=True)
                    hashes.append(h[c > 1])
                    counts.append(c[c > 1])
        if hashes:
            h, place = np.unique(np.concatenate(hashes), return_inverse=True)
            c = np.bincount(place, np.concatenate(counts), len(h)).astype(np.int64)
            many = c >= max(8, sets // HOT_SHARE)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(many.sum()), np.int32)), pa.nulls(int(many.sum()), pa.int64()), pa.array(h[many].view(np.int64)), pa.array(c[many]), pa.nulls(int(many.sum()), pa.int64())], names=["kind", "doc_id", "name", "size", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print")).mapInArrow(run, "kind int, doc_id long, name long, size long, print long")


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    return numbers.astype(kind).tobytes()


def _rows(kind: int, keys: np.ndarray, names: np.ndarray, hashes: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
    """One row for each key: runs of class names with their lengths, the hashes
    and a 32-bit number for each hash or name. Items must ascend by key, then
    name."""
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(keys))
    rows = []
    for s, e in zip(cuts.tolist(), ends.tolist()):
        own = names[s:e]
        turn = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rows.append((int(keys[s]), _packed(own[turn], "<u8"), _packed(np.diff(np.append(turn, e - s)), "<u4"), _packed(hashes[s:e], "<u8"), _packed(extra[s:e], "<u4") if len(extra) else b""))
    return _batch(kind, rows)


def _batch(kind: int, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["kind", "key", "names", "counts", "hashes", "extra"])


PACKED = "kind int, key int, names binary, counts binary, hashes binary, extra binary"
CLASSES, SHINGLES, SHARED = 0, 1, 2


def scatter(docs: DataFrame, hot: np.ndarray, bits: int) -> DataFrame:
    """Packed rows: SHINGLES by the top bits of the hash (all but hot ones), and
    CLASSES by the top bits of the class name, with sizes and hot shingles."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets: dict[int, np.ndarray] = {}
                for own in shingle_sets(part.column("text")):
                    if len(own) > 2:  # smaller ones link with equal ones only
                        sets.setdefault(class_name(own), own)
                if not sets:
                    continue
                names = np.sort(np.fromiter(sets, np.uint64, len(sets)))
                sizes = np.fromiter((len(sets[n]) for n in names.tolist()), np.int64, len(sets))
                flat = np.concatenate([sets[n] for n in names.tolist()])
                owner = np.repeat(np.arange(len(names)), sizes)
                place = np.minimum(np.searchsorted(hot, flat), max(len(hot) - 1, 0))
                is_hot = hot[place] == flat if len(hot) else np.zeros(len(flat), bool)
                cold = np.flatnonzero(~is_hot)
                key = (flat[cold] >> shift).astype(np.uint16 if bits <= 16 else np.uint32)
                order = cold[np.argsort(key, kind="stable")]
                yield _rows(SHINGLES, (flat[order] >> shift).astype(np.int64), names[owner[order]], flat[order], np.zeros(0))
                warm = np.flatnonzero(is_hot)
                counts = np.bincount(owner[warm], minlength=len(names))
                at = np.concatenate([[0], np.cumsum(counts)])
                home = (names >> shift).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
                rows = []
                for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(home)).tolist()):
                    rows.append((int(home[s]), _packed(names[s:e], "<u8"), _packed(counts[s:e], "<u4"), _packed(flat[warm][at[s] : at[e]], "<u8"), _packed(sizes[s:e], "<u4")))
                yield _batch(CLASSES, rows)

    return docs.select("text").mapInArrow(run, PACKED)


def _read(cell: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def find_shared(packed: DataFrame, bits: int) -> DataFrame:
    """CLASSES rows as they are, and SHARED rows by class: the shingles that
    two or more classes hold, with their frequencies."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes = [], []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == CLASSES).any():
                yield batch.filter(pa.array(kind == CLASSES))
            for i in np.flatnonzero(kind == SHINGLES).tolist():
                names.append(np.repeat(_read(batch.column("names")[i], "<u8"), _read(batch.column("counts")[i], "<u4")))
                hashes.append(_read(batch.column("hashes")[i], "<u8"))
        if not hashes:
            return
        h, n = np.concatenate(hashes), np.concatenate(names)
        hashes.clear(), names.clear()
        order = np.argsort(h)
        h, n = h[order], n[order]
        del order
        company = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        company[1:] |= same
        company[:-1] |= same
        h, n = h[company], n[company]
        order = np.lexsort((n, h))
        h, n = h[order], n[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1])
        h, n = h[once], n[once]
        _, place, count = np.unique(h, return_inverse=True, return_counts=True)
        df = count[place]
        h, n, df = h[df > 1], n[df > 1], df[df > 1]
        order = np.argsort(n, kind="stable")
        n = n[order]
        yield _rows(SHARED, (n >> shift).astype(np.int64), n, h[order], df[order])
        del h, n, df, order
        release()

    return packed.mapInArrow(run, PACKED)


def survivors(packed: DataFrame, hot_cost: int) -> DataFrame:
    """Classes that may have a partner: name, size, lonely (shingles that no
    other class holds), tokens (the part of the
    2-subset prefix that is shared, in order), single (how many of them make
    the 1-element prefix), shared (all shingles that others hold too) and the
    costs of subsets and of scanning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[list[np.ndarray]]] = {CLASSES: [[], [], [], []], SHARED: [[], [], [], []]}
        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                for k, (c, t) in enumerate((("names", "<u8"), ("counts", "<u4"), ("hashes", "<u8"), ("extra", "<u4"))):
                    got[kind][k].append(_read(batch.column(c)[i], t))
        if not got[CLASSES][0]:
            return
        names, counts, warm, sizes = map(np.concatenate, got[CLASSES])
        warm_owner = np.repeat(names, counts)
        names, once = np.unique(names, return_index=True)
        sizes = sizes[once].astype(np.int64)
        warm_owner = np.searchsorted(names, warm_owner)
        # A class that several tasks saw brought its hot shingles several times.
        order = np.lexsort((warm, warm_owner))
        warm, warm_owner = warm[order], warm_owner[order]
        fresh = np.ones(len(warm), bool)
        fresh[1:] = (warm[1:] != warm[:-1]) | (warm_owner[1:] != warm_owner[:-1])
        warm, warm_owner = warm[fresh], warm_owner[fresh]
        if got[SHARED][0]:
            n, c, h, df = map(np.concatenate, got[SHARED])
            owner = np.searchsorted(names, np.repeat(n, c))
        else:
            owner, h, df = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        order = np.lexsort((h, df, owner))
        owner, h, df = owner[order], h[order], df[order].astype(np.int64)
        cold_at = np.searchsorted(owner, np.arange(len(names) + 1))
        warm_at = np.searchsorted(warm_owner, np.arange(len(names) + 1))
        lonely = sizes - np.diff(cold_at) - np.diff(warm_at)
        single = sizes // 4 + 1 - lonely
        rows = []
        for i in np.flatnonzero(single > 0).tolist():
            own = h[cold_at[i] : cold_at[i + 1]]
            both = np.concatenate([own, warm[warm_at[i] : warm_at[i + 1]]])
            if not len(both):
                continue
            k = int(min(single[i], len(both)))
            tokens = both[: k + 1]
            scan = k + int(COMPARED * (df[cold_at[i] : cold_at[i] + k].sum() + hot_cost * max(0, k - len(own))))
            rows.append((int(names[i].view(np.int64)), int(sizes[i]), int(lonely[i]), _packed(tokens, "<u8"), k, _packed(np.sort(both), "<u8"), len(tokens) * (len(tokens) - 1) // 2, scan))
            if len(rows) >= 2000:
                yield out(rows)
                rows = []
        yield out(rows)
        got.clear()
        release()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        columns = list(zip(*rows)) or [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["name", "size", "lonely", "tokens", "single", "shared", "subset_cost", "scan_cost"])

    return packed.mapInArrow(run, "name long, size long, lonely long, tokens binary, single int, shared binary, subset_cost long, scan_cost long")


def boundary(found: DataFrame) -> int:
    """The largest light size, by estimated cost; sizes in quarter octaves."""
    step = F.floor(4 * F.log2("size")).cast("int")
    costs = sorted((r["step"], r["subsets"], r["scans"], r["top"]) for r in found.groupBy(step.alias("step")).agg(F.sum("subset_cost").alias("subsets"), F.sum("scan_cost").alias("scans"), F.max("size").alias("top")).collect())
    best, at, light, heavy = None, 2, 0, sum(c[2] for c in costs)
    for _, subsets, scans, top in [(0, 0, 0, 2), *costs]:
        light, heavy = light + subsets, heavy - scans
        if best is None or light + heavy < best:
            best, at = light + heavy, top
    return at


def postings(found: DataFrame, light_to: int) -> DataFrame:
    """key, name, size and room of every entry of both indexes: room is how much
    the set can share with another whose first common elements these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, rooms = [], [], []
            size, lonely, single = (batch.column(c).to_numpy() for c in ("size", "lonely", "single"))
            for i in range(batch.num_rows):
                tokens = _read(batch.column("tokens")[i], "<u8")
                left = size[i] - lonely[i] - np.arange(len(tokens))
                with np.errstate(over="ignore"):
                    if size[i] <= light_to:
                        a, b = np.triu_indices(len(tokens), 1)
                        low, high = np.minimum(tokens[a], tokens[b]), np.maximum(tokens[a], tokens[b])
                        keys.append(mix(low * MIX[50] + high * MIX[51]))
                        rooms.append(left[b] + 1)
                        rows.append(np.full(len(a), i))
                    if 4 * size[i] >= 3 * (light_to + 1):
                        keys.append(tokens[: single[i]])
                        rooms.append(left[: single[i]])
                        rows.append(np.full(len(keys[-1]), i))
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            room = np.concatenate(rooms) if rooms else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("name").take(pa.array(row)), pa.array(size[row]), pa.array(room)], names=["key", "name", "size", "room"])

    return found.select("name", "size", "lonely", "tokens", "single").mapInArrow(run, "key long, name long, size long, room long")


def may_link(a: Column, b: Column, room_a: Column, room_b: Column) -> Column:
    """Whether sets of sizes a and b can share the 3 (a + b) / 7 that a link
    takes, given the room behind their first common elements."""
    return 7 * F.least(room_a, room_b) >= 3 * (a + b)


def union(comp: np.ndarray, members: np.ndarray) -> None:
    """Give the components of ``members`` their least label."""
    labels = np.unique(comp[members])
    if len(labels) > 1:
        comp[np.isin(comp, labels)] = labels[0]


def block_components(sizes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Component (least index) of each set among these, by inverted lists.

    A set is compared with all at once: its elements' lists are counted. Only
    sets outside the largest component need that, until none is left; of two
    sets in different components one is outside it, so no link is missed."""
    n = len(sets)
    comp = np.arange(n)
    lengths = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    todo = np.ones(n, bool)
    while True:
        held = np.bincount(comp, minlength=n)
        left = np.flatnonzero(todo & (comp != held.argmax()))
        if not len(left):
            return comp
        # The member of the largest of the other components, for wide steps.
        i = left[held[comp[left]].argmax()]
        todo[i] = False
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        run, inner = spread(high - low)
        both = np.bincount(owner[low[run] + inner], minlength=n)
        union(comp, np.append(np.flatnonzero(100 * both >= PERCENT * (sizes[i] + sizes - both)), i))


def placed(index: DataFrame, found: DataFrame) -> DataFrame:
    """name, block of every class that shares a list: classes whose longest
    list is the same lie together, in blocks of bounded size."""
    lists = index.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    top = index.join(lists, "key").groupBy("name", "size").agg(F.max(F.struct("held", "key"))["key"].alias("top"))
    top = saved(top, "top-lists")
    parts = top.groupBy("top").agg(F.ceil(F.greatest(F.sum("size") / F.lit(BLOCK_SHINGLES), F.count("*") / F.lit(BLOCK_SETS))).alias("parts"))
    block = F.xxhash64("top", F.pmod(F.xxhash64("name"), F.col("parts")))
    return saved(top.join(parts, "top").select("name", block.alias("block")), "blocks")


def within_blocks(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """name, label: components by the links inside each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, sizes, sets in whole_groups(batches, "block"):
            comp = block_components(np.array(sizes), sets) if len(sets) > 1 else np.zeros(1, np.int64)
            names = np.array(names)
            least = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(least, comp, names)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(least[comp])], names=["name", "label"])

    sets = found.select("name", "size", "shared").join(blocks, "name").select("block", "name", "size", "shared")
    return sets.repartition("block").sortWithinPartitions("block").mapInArrow(run, "name long, label long")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """(key, names, sizes, sets) of each run of equal keys."""
    now, names, sizes, sets = None, [], [], []
    for batch in batches:
        shared = batch.column("shared")
        for i, (k, name, size) in enumerate(zip(batch.column(key).to_pylist(), batch.column("name").to_pylist(), batch.column("size").to_pylist())):
            if k != now and sets:
                yield now, names, sizes, sets
                names, sizes, sets = [], [], []
            now = k
            names.append(name)
            sizes.append(size)
            sets.append(np.frombuffer(shared[i].as_py(), "<u8"))
    if sets:
        yield now, names, sizes, sets


def open_lists(index: DataFrame, blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of the lists that hold several components, with the list's most
    frequent one (main)."""
    where = blocks.join(labels, "name")
    named = index.join(where, "name")
    held = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = held.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    return named.join(main.select("key", "main"), "key")


def chosen_pairs(entries: DataFrame) -> DataFrame:
    """For each open list and component one member drawn by hash, each paired
    with the one of the main component."""
    draw = F.struct(F.xxhash64("name", "key").alias("draw"), "name", "size", "room", "block")
    one = entries.groupBy("key", "label", "main").agg(F.min(draw).alias("x"))
    main = one.filter("label = main").select("key", F.col("x").alias("y"))
    met = one.filter("label != main").join(main, "key").filter(may_link(F.col("x.size"), F.col("y.size"), F.col("x.room"), F.col("y.room")))
    return _pairs(met, "x.name", "y.name", "x.block", "y.block")


def open_pairs(entries: DataFrame) -> DataFrame:
    """All pairs of different components and blocks that share an open list:
    each entry outside the main component meets all entries of others. (Pairs
    within a block have been compared.)"""
    columns = ("name", "size", "room", "block", "label")
    # Sizes of linked sets differ by a factor of 4/3 at most: by one band of 1.34 at most.
    band = F.floor(F.log("size") / math.log(1.34)).cast("int")
    near = F.explode(F.array(band - 1, band, band + 1)).alias("band")
    apart = entries.filter("label != main").select("key", near, F.struct(*columns).alias("x"))
    met = apart.join(entries.select("key", band.alias("band"), F.struct(*columns).alias("y")), ["key", "band"])
    met = met.filter((F.col("x.label") != F.col("y.label")) & (F.col("x.block") != F.col("y.block")) & may_link(F.col("x.size"), F.col("y.size"), F.col("x.room"), F.col("y.room")))
    return _pairs(met, "x.name", "y.name", "x.block", "y.block")


def _pairs(met: DataFrame, x: str, y: str, x_block: str, y_block: str) -> DataFrame:
    tile = F.xxhash64(F.least(x_block, y_block), F.greatest(x_block, y_block))
    return met.select(tile.alias("tile"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs that link, enough of them for the components. A set travels once
    for each tile (pair of blocks) in which it has pairs, not for each pair; a
    tile of many pairs is a square grid of parts, by hashes of both sets."""
    pairs = saved(pairs, "pairs")
    grid = pairs.groupBy("tile").agg(F.ceil(F.sqrt(F.count("*") / F.lit(TILE_PAIRS))).alias("grid"))
    place = [F.pmod(F.xxhash64(F.lit(7), c), F.col("grid")) for c in ("a", "b")]
    pairs = saved(pairs.join(grid, "tile").select(F.xxhash64("tile", *place).alias("tile"), "a", "b"), "pairs")
    needed = pairs.select("tile", F.explode(F.array("a", "b")).alias("name")).distinct()
    sets = needed.join(found.select("name", "size", "shared"), "name").select("tile", F.lit(0).alias("kind"), "name", F.lit(None).cast("long").alias("b"), "size", "shared")
    asked = pairs.select("tile", F.lit(1).alias("kind"), F.col("a").alias("name"), "b", F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, top = None, {}, {}

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        for batch in batches:
            links = []
            shared = batch.column("shared")
            rows = zip(*(batch.column(c).to_pylist() for c in ("tile", "kind", "name", "b", "size")))
            for i, (tile, kind, name, b, size) in enumerate(rows):
                if tile != now:
                    now, sets, top = tile, {}, {}
                if kind == 0:
                    sets[name], top[name] = (size, np.frombuffer(shared[i].as_py(), "<u8")), name
                    continue
                p, q = root(name), root(b)
                if p == q:
                    continue
                (m, x), (n, y) = sets[name], sets[b]
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                if 100 * both >= PERCENT * (m + n - both):
                    top[q] = p
                    links.append((name, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in links], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return sets.unionByName(asked).repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(run, "a long, b long")


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after joining the components that ``links`` connect."""
    name = lambda c: labels.select(F.col("name").alias(c), F.col("label").alias(f"{c}_label"))
    between = links.join(name("a"), "a").join(name("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).filter("a != b").distinct()
    between = saved(between, "links")
    if between.isEmpty():
        return labels
    top = label_components(between).select(F.col("name").alias("label"), F.col("label").alias("top"))
    return saved(labels.join(top, "label", "left").select("name", F.coalesce("top", "label").alias("label")), "labels")


def label_components(links: DataFrame) -> DataFrame:
    """name, label: the least name that links reach, for every name in them."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "adjacency")
    labels = saved(both.groupBy(F.col("a").alias("name")).agg(F.min("b").alias("b")).select("name", F.least("name", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("name").alias("b"), "label"), "b").groupBy(F.col("a").alias("name")).agg(F.min("label").alias("near"))
        step = labels.join(near, "name").select("name", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("name").alias("next"), F.col("label").alias("far"))
        after = saved(step.join(jump, "next").select("name", "label", F.least("next", "far").alias("after")), "labels")
        labels = after.select("name", F.col("after").alias("label"))
        if after.filter("label != after").isEmpty():
            return labels


def class_labels(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """name, label of every class that links with another."""
    spark = docs.sparkSession
    known = profiles.filter("kind = 0").groupBy("name").agg(F.max("size").alias("size")).agg(F.count("*").alias("sets"), F.coalesce(F.sum("size"), F.lit(0)).alias("shingles")).first()
    sets = known["sets"]
    hot_from = max(HOT_LEAST, sets // HOT_SHARE)
    # At most HOT_SHARE times the mean set size: each holds so many of the sets.
    hot_rows = profiles.filter("kind = 1").groupBy("name").agg(F.sum("size").alias("n")).filter(F.col("n") >= hot_from).select("name").toPandas()
    hot = np.sort(hot_rows["name"].to_numpy(np.int64).view(np.uint64))
    # Ranges follow the data where shuffle partitions would leave too much for a task.
    bits = max(3, (max(partitions(spark), -(-known["shingles"] // RANGE_SHINGLES)) - 1).bit_length())
    ranges = 1 << bits
    packed = find_shared(scatter(docs, hot, bits).repartitionById(ranges, F.col("key")), bits)
    found = saved(survivors(packed.repartitionById(ranges, F.col("key")), hot_from), "survivors")
    light_to = boundary(found)
    index = saved(postings(found, light_to), "postings")
    blocks = placed(index, found)
    labels = saved(within_blocks(found, blocks), "labels")
    for pairs in (chosen_pairs, open_pairs):
        entries = saved(open_lists(index, blocks, labels), "open-lists")
        labels = joined_labels(labels, verified(pairs(entries), found))
    return labels


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows of ``docs``, and name, label of every class."""
    profiles = saved(profile(docs), "profiles")
    labels = class_labels(docs, profiles)
    classes = profiles.filter("kind = 0 and size > 0").groupBy("name").agg(F.min("doc_id").alias("least"))
    return profiles, classes.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    profiles, classes = labelled(docs)
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = saved(classes.join(least, "label").select("name", "component_id"), "classes")
    out = profiles.filter("kind = 0 and size > 0").join(named, "name").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return out.unionByName(profiles.filter("kind = 0 and size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one of its least doc_id.
    Rows without words stay."""
    profiles, classes = labelled(docs)
    # Rows of equal doc_id and text are one candidate.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    rows = profiles.filter("kind = 0 and size > 0").groupBy("name", "doc_id", "print").agg(F.count("*").alias("n"))
    own = saved(rows.groupBy("name").agg(F.min(rank).alias("best")).join(classes, "name"), "classes")
    best = own.groupBy("label").agg(F.min("best").alias("best"))
    named = saved(own.select("name", "label").join(best, "label").select("name", "best"), "kept")
    judged = rows.join(named, "name").select("doc_id", "print", "n", (rank == F.col("best")).alias("stays"))
    judged = saved(judged.filter("not stays or n > 1"), "copies")
    text_hash = free_name(docs, "print")
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col("copy_id"))) & (F.col(text_hash) == F.col("copy_print"))
    copies = judged.select(F.col("doc_id").alias("copy_id"), F.col("print").alias("copy_print"), "stays")
    left = docs.withColumn(text_hash, F.xxhash64("text")).join(copies.filter("not stays").drop("stays"), same, "left_anti")
    repeated = copies.filter("stays").drop("stays")
    if not repeated.isEmpty():
        row = F.struct(*docs.columns)
        once = left.join(repeated, same, "left_semi").groupBy("doc_id", text_hash).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        left = left.join(repeated, same, "left_anti").select(docs.columns).unionByName(once)
    return left.select(docs.columns)
