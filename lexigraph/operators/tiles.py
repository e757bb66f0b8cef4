"""All pairs of books, block by block.

``packed`` numbers the books, those whose commonest word is the same next to
each other, and writes each ``BLOCK`` of them as one cell of postings by word.
``over`` meets every two blocks once, in a Cartesian product that reads the
cells from the shared folder and shuffles nothing, and hands the sums of each
tile to a handler, which keeps or returns only what its question needs.

A word that fills much of a tile is added up by matrix products, one column for
each count that enough books reach (the sum of smaller counts is the number of
levels that both reach); what is left over, and all rarer words, by counting the
meetings of postings. All sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import saved

BLOCK = 1024
#: Words that books are ordered by, and terms or books up to which a join broadcasts them.
LEADS, FEW = 64, 1_000_000
#: Share of a tile's pairs that a word must meet to be columns, and each higher count to be one.
FULL, FULL_LEVEL = 0.05, 0.02
#: Counts that can be columns.
STEPS = 64
#: Cells that a task holds, and bytes of a batch of them between the JVM and Python.
CELLS, BATCH_BYTES = 4, 8 << 20
#: Meetings added up at once, about, and partitions of either side of the product at most.
MEETINGS, SIDE = 1 << 17, 16
#: Sums of words below this are exact in float32, and two of them in a float64.
SMALL = 1 << 23
SHIFT = float(1 << 26)
KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


class Packed(NamedTuple):
    #: block, ids and data of every block; book_id and number of every book that shares a word.
    blocks: DataFrame
    numbers: DataFrame
    size: int


def _numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df`` written with a number from 0 in the order of its rows."""
    at = F.monotonically_increasing_id()
    rows = saved(df.withColumn("_at", at), label)
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(rows.groupBy(part.alias("part")).count().collect())
    firsts, total = [], 0
    for r in sizes:
        firsts += [F.lit(r["part"]), F.lit(total)]
        total += r["count"]
    first = F.create_map(*firsts)[part] if firsts else F.lit(0)
    return rows.withColumn(name, (first + place).cast("long")).drop("_at")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def packed(index: DataFrame, size: int = BLOCK) -> Packed:
    # A word of one book makes no pair.
    terms = _numbered(index.groupBy("word").agg(F.count("*").alias("held")).filter("held > 1"), "code", "terms")
    leads = np.array(sorted(r["code"] for r in terms.orderBy(F.desc("held"), "word").limit(LEADS).collect()), np.int64)
    rows = index.join(_few(terms.select("word", "code")), "word").select("book_id", F.col("code").cast("int").alias("code"), F.col("count").cast("long").alias("count"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings of one book that stand together as one row, with their commonest frequent word."""
        for batch in batches:
            book, code, count = (batch[c].to_numpy(zero_copy_only=False) for c in ("book_id", "code", "count"))
            if not len(book):
                continue
            order = np.argsort(book, kind="stable")
            book, code, count = book[order], code[order], count[order]
            start = np.flatnonzero(np.append(True, book[1:] != book[:-1]))
            ends = np.append(start[1:], len(book))
            common = np.where(np.isin(code, leads), count, 0)
            most = np.maximum.reduceat(common, start)
            lead = np.maximum.reduceat(np.where((common == np.repeat(most, ends - start)) & (common > 0), code, -1), start)
            data = [code[s:e].tobytes() + count[s:e].tobytes() for s, e in zip(start.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_pydict({"book_id": book[start], "most": most, "lead": lead.astype(np.int32), "data": pa.array(data, pa.binary())})

    held = saved(rows.mapInArrow(pieces, "book_id long, most long, lead int, data binary"), "pieces")
    books = held.groupBy("book_id").agg(F.max(F.struct("most", "lead"))["lead"].alias("lead"))
    numbers = _numbered(books.orderBy("lead", F.xxhash64("book_id"), "book_id").select("book_id"), "number", "numbers")
    n = numbers.count()
    block, row = F.expr(f"cast(number div {size} as int)"), F.expr(f"cast(number % {size} as int)")
    placed = held.join(_few(numbers), "book_id").select(block.alias("block"), row.alias("row"), "data")

    def pack(t: pa.Table) -> pa.Table:
        data = t["data"].to_pylist()
        lengths = np.array([len(x) // 12 for x in data])
        code = np.concatenate([np.frombuffer(x, np.int32, n) for x, n in zip(data, lengths.tolist())])
        count = np.concatenate([np.frombuffer(x, np.int64, n, 4 * n) for x, n in zip(data, lengths.tolist())])
        row = np.repeat(t["row"].to_numpy(), lengths)
        order = np.lexsort((row, code))
        cell = code[order].tobytes() + row[order].astype(np.int32).tobytes() + count[order].tobytes()
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "data": pa.array([cell], pa.binary())})

    ids = numbers.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("number", "book_id")))["book_id"].alias("ids"))
    cells = placed.repartition(max(1, 2 * -(-n // size)), "block").groupBy("block").applyInArrow(pack, "block int, data binary")
    return Packed(saved(cells.join(F.broadcast(ids), "block"), "blocks"), numbers, size)


class Cell:
    """A block's postings, sorted by word."""

    def __init__(self, block: int, ids: np.ndarray, data: bytes):
        self.block, self.ids, n = block, ids, len(data) // 16
        code = np.frombuffer(data, np.int32, n)
        self.row, self.count = np.frombuffer(data, np.int32, n, 4 * n), np.frombuffer(data, np.int64, n, 8 * n)
        self.start = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if n else np.zeros(0, np.int64)
        self.words, self.length = code[self.start], np.diff(np.append(self.start, n))
        self.most = int(np.bincount(self.row, self.count, len(ids)).max()) if n else 0
        # the same by row: each posting's row, count and place among the words
        narrow = self.row.astype(np.int16) if len(ids) < 1 << 15 else self.row  # sorted by digits
        order = np.argsort(narrow, kind="stable")
        self.by_row = self.row[order].astype(np.int64), self.count[order], np.repeat(np.arange(len(self.words)), self.length)[order]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


def _add(out: list[np.ndarray], row: np.ndarray, x: np.ndarray, first: np.ndarray, times: np.ndarray, b_row: np.ndarray, y: np.ndarray, both: bool) -> None:
    """Adds, for postings of rows in ascending order that meet ``times`` postings of b from ``first`` on,
    the smaller counts to out[0] and, if asked, both counts to out[1], or with a single out as one
    number. A row's cells stay in the processor's cache."""
    width = out[0].shape[1]
    met = np.cumsum(times)
    s = 0
    while s < len(row):
        e = int(np.searchsorted(met, (met[s - 1] if s else 0) + MEETINGS, "right"))
        e = int(np.searchsorted(row, row[max(e, s + 1) - 1], "right"))  # whole rows
        low, high = row[s], row[e - 1] + 1
        n, t = (high - low) * width, times[s:e]
        at = _ranges(first[s:e], t)
        cell = np.repeat((row[s:e] - low) * width, t) + b_row[at]
        if x is None:
            values = [y[at]]
        else:
            u, v = np.repeat(x[s:e], t), y[at]
            least = np.minimum(u, v)
            values = [least] if not both else [least + (u + v) * SHIFT] if len(out) == 1 else [least, u + v]
        for o, value in zip(out, values):
            o[low:high] += np.bincount(cell, value, n).reshape(-1, width)
        s = e


def sums(a: Cell, b: Cell, shared: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of every pair of the two blocks' books, over the words that both hold: sum of
    smaller counts, sum of larger counts, and their number if asked."""
    na, nb = len(a.ids), len(b.ids)
    small = a.most + b.most < SMALL
    real = np.float32 if small else np.float64
    _, ia, ib = np.intersect1d(a.words, b.words, assume_unique=True, return_indices=True)
    met = a.length[ia] * b.length[ib]
    full = met > max(16.0, FULL * na * nb)
    enough = max(16.0, FULL_LEVEL * na * nb)
    least, total, number = np.zeros((na, nb), real), np.zeros((na, nb), real), np.zeros((na, nb), real) if shared else None
    rest: list[tuple[np.ndarray, ...]] = []
    if full.any():

        def table(cell: Cell, of: np.ndarray, n: int) -> np.ndarray:
            at = _ranges(cell.start[of], cell.length[of])
            out = np.zeros((n, len(of)), real)
            out[cell.row[at], np.repeat(np.arange(len(of)), cell.length[of])] = cell.count[at]
            return out

        x, y = table(a, ia[full], na), table(b, ib[full], nb)
        one, two = (x > 0).astype(real), (y > 0).astype(real)
        total = np.hstack([x, one]) @ np.hstack([two, y]).T
        if shared:
            number = one @ two.T
        columns, level, slot = [(one, two)], 0, 0
        while x.shape[1]:
            level += 1
            has_x, has_y = x > level, y > level
            met_x, met_y = has_x.sum(0), has_y.sum(0)
            dense = met_x * met_y > enough
            few = ~dense & (met_x > 0) & (met_y > 0)
            if few.any():
                (w, r), (v, q) = np.nonzero(has_x[:, few].T), np.nonzero(has_y[:, few].T)
                rest.append((r, x[:, few].T[w, r] - level, slot + w, q, y[:, few].T[v, q] - level, met_y[few]))
                slot += len(met_y[few])
            x, y = x[:, dense], y[:, dense]
            columns.append((has_x[:, dense].astype(real), has_y[:, dense].astype(real)))
            if level == STEPS:
                # what all that is left reaches beyond, word by word
                for w in range(x.shape[1]):
                    least += np.minimum.outer(np.maximum(x[:, w] - level - 1, 0), np.maximum(y[:, w] - level - 1, 0))
                x = x[:, :0]
            if sum(c[0].shape[1] for c in columns) > 2 * BLOCK or not x.shape[1]:
                least += np.hstack([c[0] for c in columns]) @ np.hstack([c[1] for c in columns]).T
                columns = []
    if not full.all():
        ia, ib = ia[~full], ib[~full]
        times, first = np.zeros((2, len(a.words)), np.int64)
        times[ia], first[ia] = b.length[ib], b.start[ib]
        row, count, word = a.by_row
        out = [np.zeros((na, nb))] if small else [np.zeros((na, nb)), np.zeros((na, nb))]
        # a count of 1 is the smaller one, whatever the other is
        single = count == 1 if small else np.zeros(len(row), bool)
        for mine, x, y in ((single, None, b.count * SHIFT + (SHIFT + 1)), (~single, count, b.count)):
            mine = mine & (times[word] > 0)
            _add(out, row[mine], x if x is None else x[mine], first[word[mine]], times[word[mine]], b.row, y, True)
        if small:
            both = np.floor(out[0] / SHIFT)
            out = [out[0] - both * SHIFT, both]
        least += out[0]
        total += out[1]
        if shared:
            mine = times[word] > 0
            out = [np.zeros((na, nb))]
            _add(out, row[mine], None, first[word[mine]], times[word[mine]], b.row, np.ones(len(b.row)), False)
            number += out[0]
    if rest:
        row, x, word, b_row, y, times = (np.concatenate([r[i] for r in rest]) for i in range(6))
        first, order = np.cumsum(times) - times, np.argsort(row, kind="stable")
        out = [np.zeros((na, nb))]
        _add(out, row[order], x[order], first[word[order]], times[word[order]], b_row, y, False)
        least += out[0]
    return least, total - least, number


def similarity(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Not a number where no word is shared."""
    with np.errstate(invalid="ignore"):
        return np.divide(least, most, dtype=np.float64)


def cell_of(words: pa.Array, counts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, known: pa.Array) -> Cell:
    """Books whose words and counts stand one after the other, as a block of what they hold of the known words."""
    code = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
    row = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    has = np.flatnonzero((code >= 0) & (counts > 0))
    has = has[np.argsort(code[has], kind="stable")]  # rows are in order already
    return Cell(-1, ids, code[has].astype(np.int32).tobytes() + row[has].tobytes() + counts[has].astype(np.int64).tobytes())


def beside(bags: DataFrame, own: pa.Table, threshold: float, ends: bool = False) -> DataFrame:
    """a < b and similarity of the edges from the few books ``own`` to all of ``bags`` (a row for each
    book: book_id, words, counts), or with ``ends`` just the id of each book that has such an edge, now
    and then more than once. A book meets ``own`` where it is read, so nothing is shuffled."""
    own = own.combine_chunks()
    words, lengths = own["words"].combine_chunks().flatten(), pc.list_value_length(own["words"]).to_numpy()
    counts, ids, known = own["counts"].combine_chunks().flatten().to_numpy(), own["book_id"].to_numpy(), words.unique()
    stop = np.append(0, np.cumsum(lengths))
    cuts = range(0, len(ids), BLOCK)
    parts = [(words[stop[s] : stop[e]], counts[stop[s] : stop[e]], lengths[s:e], ids[s:e]) for s in cuts for e in (min(s + BLOCK, len(ids)),)]
    given = bags.sparkSession.sparkContext.broadcast((known, parts))
    schema = "id long" if ends else "a long, b long, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = given.value
        asked = [cell_of(*part, known) for part in parts]
        mine = np.sort(np.concatenate([x.ids for x in asked])) if asked else np.zeros(0, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                some = batch.slice(first, BLOCK)
                lengths = pc.list_value_length(some["words"]).to_numpy()
                b = cell_of(some["words"].flatten(), some["counts"].flatten().to_numpy(), lengths, some["book_id"].to_numpy(), known)
                other = ~np.isin(b.ids, mine)
                for a in asked:
                    least, most, _ = sums(a, b)
                    i, j = np.nonzero((similarity(least, most) > threshold) & (a.ids[:, None] != b.ids))
                    if ends:
                        yield pa.RecordBatch.from_pydict({"id": np.unique(np.concatenate([a.ids[i], b.ids[j]]))})
                        continue
                    once = other[j] | (a.ids[i] < b.ids[j])  # both are own: the pair comes twice
                    i, j = i[once], j[once]
                    x, y = a.ids[i], b.ids[j]
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y), "similarity": similarity(least[i, j], most[i, j])})

    return bags.filter("book_id is not null").select("book_id", "words", "counts").mapInArrow(run, schema)


class Handler:
    """What is done with each tile, and at a task's end; both may return rows."""

    schema = ""
    shared = False

    def tile(self, a: Cell, b: Cell, least: np.ndarray, most: np.ndarray, number: np.ndarray | None) -> Iterator[dict]:
        yield from ()

    def end(self) -> Iterator[dict]:
        yield from ()


def over(p: Packed, made: Callable[[], Handler]) -> DataFrame:
    """The handler's rows from all tiles; each two blocks meet once, a block also itself
    (all of its pairs then come twice, and each book with itself sums to nothing)."""
    conf, key = p.blocks.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "-1"):  # Spark's default, and no bound
        conf.set(key, str(BATCH_BYTES))
    blocks = p.blocks.coalesce(SIDE)
    left, right = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in ("block", "ids", "data"))) for side in "lr")
    even = (F.col("l_block") + F.col("r_block")) % 2 == 0
    once = (even & (F.col("l_block") <= F.col("r_block"))) | (~even & (F.col("l_block") > F.col("r_block")))
    pairs = left.hint("shuffle_replicate_nl").join(right, once)
    handler = made()
    schema, shared = handler.schema, handler.shared
    arrow = pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        own, kept = made(), {}
        told = lambda rows: (pa.RecordBatch.from_pydict(r, arrow) for r in rows)

        def cell(batch: pa.RecordBatch, side: str, i: int) -> Cell:
            block = batch[f"{side}_block"][i].as_py()
            if block not in kept:
                if len(kept) >= CELLS:
                    del kept[next(iter(kept))]
                ids = batch[f"{side}_ids"][i].values.to_numpy(zero_copy_only=False).copy()
                kept[block] = Cell(block, ids, batch[f"{side}_data"][i].as_py())
            return kept[block]

        for batch in batches:
            for i in range(batch.num_rows):
                a, b = cell(batch, "l", i), cell(batch, "r", i)
                least, most, number = sums(a, b, shared)
                if a.block == b.block:
                    np.fill_diagonal(least, 0)
                    np.fill_diagonal(most, 0)
                yield from told(own.tile(a, b, least, most, number))
        yield from told(own.end())

    return pairs.mapInArrow(run, schema)


class Pairs(Handler):
    """Every pair above a threshold: a < b, shared_words, minimum, maximum, similarity, and that to
    six digits."""

    def __init__(self, threshold: float, shared: bool):
        self.threshold, self.shared = threshold, shared
        self.schema = "a long, b long, similarity double, rounded double" + (", shared_words long, minimum long, maximum long" if shared else "")

    def tile(self, a, b, least, most, number):
        near = similarity(least, most)
        keep = (near > self.threshold) & (most > 0)
        if a.block == b.block:
            keep = np.triu(keep, 1)
        for first in range(0, len(keep), 256):
            i, j = np.nonzero(keep[first : first + 256])
            if not len(i):
                continue
            i += first
            x, y, s = a.ids[i], b.ids[j], near[i, j]
            out = {"a": np.minimum(x, y), "b": np.maximum(x, y), "similarity": s, "rounded": np.floor(s * 1e6 + 0.5) / 1e6}
            if self.shared:
                out |= {"shared_words": number[i, j].astype(np.int64), "minimum": least[i, j].astype(np.int64), "maximum": most[i, j].astype(np.int64)}
            yield out


class Degrees(Handler):
    """id, level and degree (over 0) of books, added up over a task's tiles."""

    schema = "id long, level int, degree long"

    def __init__(self, levels: tuple[float, ...]):
        self.levels, self.found = levels, {}

    def tile(self, a, b, least, most, number):
        near = similarity(least, most)
        for k, level in enumerate(self.levels):
            hit = near > level
            for cell, axis in ((a, 1), (b, 0))[: 1 + (a.block != b.block)]:
                _, degree = self.found.setdefault((cell.block, k), (cell.ids, np.zeros(len(cell.ids), np.int64)))
                degree += hit.sum(axis)
        yield from ()

    def end(self):
        for (_, k), (ids, degree) in self.found.items():
            has = degree > 0
            yield {"id": ids[has], "level": np.full(has.sum(), k, np.int32), "degree": degree[has]}


def degrees(p: Packed, levels: tuple[float, ...]) -> DataFrame:
    """id, level (its place) and degree of every book with an edge."""
    return over(p, lambda: Degrees(levels)).groupBy("id", "level").agg(F.sum("degree").alias("degree"))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of n numbers."""
    labels = np.arange(n)
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, low, high = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(labels, high, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


class Forest(Handler):
    """Links (level and two numbers of books) that join the books as all edges of a task do."""

    schema = "level int, a long, b long"

    def __init__(self, levels: tuple[float, ...], size: int):
        self.levels, self.size = levels, size
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in levels]

    def tile(self, a, b, least, most, number):
        near = similarity(least, most)
        na, first_a, first_b = len(a.ids), a.block * self.size, b.block * self.size
        for k, level in enumerate(self.levels):
            rest = near > level
            x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
            while True:
                i = np.flatnonzero(rest.any(1))
                if not len(i):
                    break
                j = np.flatnonzero(rest.any(0))
                x, y = np.concatenate([x, i, rest[:, j].argmax(0)]), np.concatenate([y, rest[i].argmax(1), j])
                labels = joined(na + len(b.ids), x, na + y)
                rest &= labels[:na, None] != labels[None, na:]
            if len(x):
                labels = joined(na + len(b.ids), x, na + y)
                at = np.arange(len(labels))
                number_of = np.where(at < na, first_a + at, first_b + at - na)
                moved = labels != at
                self.found[k].append((number_of[labels[moved]], number_of[moved]))
                if len(self.found[k]) >= 64:
                    self.found[k] = [self.merged(k)]
        yield from ()

    def merged(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*self.found[k]))
        names, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = joined(len(names), places[: len(a)], places[len(a) :])
        moved = labels != np.arange(len(names))
        return names[labels[moved]], names[moved]

    def end(self):
        for k in range(len(self.levels)):
            if self.found[k]:
                a, b = self.merged(k)
                yield {"level": np.full(len(a), k, np.int32), "a": a, "b": b}


class Levels(Handler):
    """Degrees and Forest of the same tiles; a degree's row has no b."""

    schema = "level int, a long, b long, degree long"

    def __init__(self, levels: tuple[float, ...], size: int):
        self.parts = Degrees(levels), Forest(levels, size)

    def tile(self, *given):
        for part in self.parts:
            yield from part.tile(*given)

    def end(self):
        for r in self.parts[0].end():
            yield {"level": r["level"], "a": r["id"], "b": pa.nulls(len(r["id"]), pa.int64()), "degree": r["degree"]}
        for r in self.parts[1].end():
            yield r | {"degree": pa.nulls(len(r["a"]), pa.int64())}


class Bits(Handler):
    """The edges of each two blocks, a bit for each pair, with their number, that of those that can't be
    (of a book with itself, or a similarity not over 0 or over 1), and that of those not above the threshold."""

    schema = "low int, high int, wide int, bits binary, edges long, invalid long, below_threshold long"

    def __init__(self, threshold: float):
        self.threshold = threshold

    def tile(self, a, b, least, most, number):
        near = similarity(least, most)
        hit = near > self.threshold
        if hit.any():
            value, times = near[hit], 2 if a.block == b.block else 1  # a block's own pairs come twice
            invalid = (value <= 0) | (value > 1)
            if np.intersect1d(a.ids, b.ids).size:
                invalid |= (a.ids[:, None] == b.ids)[hit]
            counts = {"edges": len(value), "invalid": -(-int(invalid.sum()) // times) * times, "below_threshold": int((value <= self.threshold).sum())}
            yield {"low": [a.block], "high": [b.block], "wide": [len(b.ids)], "bits": [np.packbits(hit, axis=1).tobytes()]} | {k: [v // times] for k, v in counts.items()}


def bits(p: Packed, threshold: float) -> DataFrame:
    """The adjacency matrix, written; blocks without an edge between them have no row."""
    return saved(over(p, lambda: Bits(threshold)), "bits")


def unpacked(row: bytes, wide: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(row, np.uint8).reshape(-1, -(-wide // 8)), axis=1, count=wide)


#: The eight bits of each byte.
BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def products(row: bytes, wide: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits times ``high``, and ``low`` times bits: eight columns at once, by what each byte adds."""
    cells = np.frombuffer(row, np.uint8).reshape(-1, -(-wide // 8))
    n = cells.shape[1]
    at = cells + np.arange(0, 256 * n, 256)
    padded = np.zeros(8 * n)
    padded[:wide] = high
    across = (padded.reshape(n, 8) @ BYTES.T).ravel()[at].sum(1)
    down = np.bincount(at.ravel(), np.repeat(low, n), 256 * n).reshape(n, 256) @ BYTES
    return across, down.ravel()[:wide]


class Matrix:
    """Products of the adjacency matrix with vectors that the driver holds, by number of book."""

    def __init__(self, p: Packed, matrix: DataFrame):
        self.spark, self.size, self.n = matrix.sparkSession, p.size, p.numbers.count()
        self.rows = matrix.coalesce(max(1, self.spark.sparkContext.defaultParallelism))
        self.numbers = p.numbers

    def times(self, vector: np.ndarray) -> np.ndarray:
        size, given = self.size, self.spark.sparkContext.broadcast(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            part = lambda k: given.value[k * size : (k + 1) * size]
            for batch in batches:
                for low, high, wide, row in zip(*(batch[c].to_pylist() for c in ("low", "high", "wide", "bits"))):
                    across, down = products(row, wide, part(low), part(high))
                    found[low] = found.get(low, 0) + across
                    if low != high:
                        found[high] = found.get(high, 0) + down
            if found:
                yield pa.RecordBatch.from_pydict({"block": pa.array(list(found), pa.int32()), "sums": pa.array([x.tobytes() for x in found.values()], pa.binary())})

        out = np.zeros(self.n)
        for r in sorted(self.rows.mapInArrow(run, "block int, sums binary").collect()):
            part = np.frombuffer(bytes(r["sums"]))
            out[r["block"] * size : r["block"] * size + len(part)] += part
        given.destroy()
        return out

    def faults(self) -> DataFrame:
        """One row: edges, invalid ones and those not above the threshold."""
        return self.rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("edges", "invalid", "below_threshold")))

    def first(self, rank: np.ndarray, k: int) -> DataFrame:
        """number, and the ranks of its k neighbours of lowest rank."""
        size, n, given = self.size, self.n, self.spark.sparkContext.broadcast(rank)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}

            def add(block: int, hit: np.ndarray, other: int) -> None:
                ranks = given.value[other * size : other * size + hit.shape[1]]
                order = np.argsort(ranks)
                hit, ranks, rows = hit[:, order], ranks[order], np.arange(len(hit))
                best = [found[block]] if block in found else []
                for _ in range(k):
                    at = hit.argmax(1)
                    best.append(np.where(hit[rows, at], ranks[at], n)[:, None])
                    hit[rows, at] = False
                found[block] = np.sort(np.hstack(best), axis=1)[:, :k]

            for batch in batches:
                for low, high, wide, row in zip(*(batch[c].to_pylist() for c in ("low", "high", "wide", "bits"))):
                    hit = unpacked(row, wide).view(bool)
                    add(low, hit, high)
                    if low != high:
                        add(high, hit.T, low)
            for block, best in found.items():
                i, j = np.nonzero(best < n)
                yield pa.RecordBatch.from_pydict({"number": block * size + i, "rank": best[i, j]})

        met = self.rows.mapInArrow(run, "number long, rank long")
        place = F.row_number().over(Window.partitionBy("number").orderBy("rank"))
        return met.withColumn("place", place).filter(F.col("place") <= k)

    def table(self, **columns: np.ndarray) -> DataFrame:
        """book_id and the given vectors' values, of all books with a number."""
        given = self.spark.sparkContext.broadcast(columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch["number"].to_numpy()
                yield pa.RecordBatch.from_pydict({"book_id": batch["book_id"], **{k: v[at] for k, v in given.value.items()}})

        return self.numbers.mapInArrow(run, "book_id long, " + ", ".join(f"{c} {'long' if v.dtype.kind == 'i' else 'double'}" for c, v in columns.items()))


def pagerank(matrix: Matrix, nodes: int, damping: float = 0.85, tolerance: float = 1e-11, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Scores and degrees of the books with a number, and the score of one without an edge.

    An undirected graph's equations are symmetric and positive definite when scaled by the
    roots of the degrees, so conjugate gradients solve them; the sum of a plain iteration's
    changes, which is the scaled residual's, is below the tolerance at the end."""
    degree = matrix.times(np.ones(matrix.n))
    has = degree > 0
    lonely = nodes - int(has.sum())
    base = (1 - damping) / (nodes - damping * lonely) if nodes else 0.0
    root = np.sqrt(degree)
    inverse = np.divide(1.0, root, out=np.zeros(matrix.n), where=has)

    def residual(y: np.ndarray) -> np.ndarray:
        return base * inverse - (y - damping * inverse * matrix.times(inverse * y))

    total = degree.sum()
    start = np.where(has, (1 - damping) / max(nodes, 1) + damping * degree / max(total, 1), 0)
    y = start * inverse
    rest = residual(y)
    way, power = rest, rest @ rest
    for _ in range(rounds):
        if (root * np.abs(rest)).sum() < tolerance:
            # the true residual, and with it one plain iteration
            rest = residual(y)
            if (root * np.abs(rest)).sum() < 10 * tolerance:
                return np.where(has, root * (y + rest), base), degree.astype(np.int64), base
            way, power = rest, rest @ rest
        moved = way - damping * inverse * matrix.times(inverse * way)
        step = power / (way @ moved)
        y, rest = y + step * way, rest - step * moved
        way, power = rest + (rest @ rest) / power * way, rest @ rest
    raise ValueError("PageRank did not converge.")
