"""Language identification by unigram pieces, all segmentations summed.

The vocabulary is fixed and public: the pieces of a sentencepiece model, read
as a list of strings. For each language a probability is learned for every
piece; a word's probability is the sum over all its segmentations into pieces
of the product of their probabilities (forward algorithm), and a text's is the
product over its words. Nothing but the text is used to predict.

Learning is expectation-maximisation on a bounded sample of the labelled rows:
expected piece counts come from the forward and backward sums under the
current probabilities, start being equal for all languages. Equal texts of one
language count once, and every language has an equal share of the bound.

All ordinary pieces of the vocabulary take part, found by walking a trie from
every character of a word; a character outside the vocabulary counts as one
unknown piece. Words (white-space runs, with the vocabulary's word mark in front,
lower-cased) are scored whole, however long, numpy running the recursion over all
words of like length at once, one place after another; sums that get small are
scaled up, for each word and language. A word of more than ``LONG`` characters is
scored through a window that moves along it; in learning, and only there, it
counts as several of that length. Each distinct word of a batch is scored once, and
a worker keeps the scores of many.

A text that is null or has no letter gets ``und`` and score 0; ties go to the
first language in order; repeated rows get equal rows; an empty table gives no
rows; extra columns are left aside. With no labelled rows all is ``und``. A row
without doc_id is predicted, and is neither learned from nor held out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_spans, mix, saved, slices, text_buffer, word_spans

MARK = "▁"
#: Characters of a word that is taken as a whole; places of a group of words.
LONG = 1 << 17
CELLS = 1 << 17
#: Words whose scores a worker keeps.
KEEP = 400_000
#: Sums below this are scaled up; a check every so many places is enough for probabilities above 1e-20.
SMALL = 1e-100
CHECK = 8
#: Labelled rows that the probabilities are fitted on, at most.
FIT_ROWS = 20_000
ROUNDS = 2
SMOOTH = 0.5
SPACE = np.ones(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False


def pieces_of(path: str) -> list[str]:
    """The vocabulary's ordinary pieces, all of them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted(set(names))


class Lattice:
    """Which pieces lie where in words, by a trie: shared by learning and scoring."""

    def __init__(self, pieces: list[str]):
        children: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = children.setdefault((node, c), len(children) + 1)
            ends[node] = k
        self.unknown, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.piece = np.full(len(children) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        # Children in an open hash table of (node, character), four times as large as needed.
        keys = np.array([n << 21 | ord(c) for n, c in children], np.uint64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.child = np.full(1 << bits, 2**64 - 1, np.uint64), np.zeros(1 << bits, np.int32)
        child, slot = np.array(list(children.values()), np.int32), (mix(keys) >> self.shift).astype(np.int64)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] == np.uint64(2**64 - 1)
            self.keys[slot[free]], self.child[slot[free]] = keys[free], child[free]
            left = self.keys[slot] != keys  # taken before, or by another of these
            keys, child, slot = keys[left], child[left], slot[left] + 1 & self.mask
        placed = self.keys != np.uint64(2**64 - 1)
        assert placed.sum() == len(children)

    def step(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The children of ``node`` by ``point``; 0: none."""
        key = node.astype(np.uint64) << np.uint64(21) | point.astype(np.uint64)
        slot = (mix(key) >> self.shift).astype(np.int64)
        found = self.keys[slot] == key
        out = np.where(found, self.child[slot], 0)
        left = np.flatnonzero(~found & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slot[left] = slot[left] + 1 & self.mask
            held = self.keys[slot[left]]
            hit = held == key[left]
            out[left[hit]] = self.child[slot[left[hit]]]
            left = left[~hit & (held != np.uint64(2**64 - 1))]
        return out

    def edges(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and piece of all pieces in words given as columns of code
        points (characters, words); a place is character times words plus word."""
        width, n = points.shape
        flat = points.ravel()
        at = np.flatnonzero((np.arange(width)[:, None] < lengths[None, :]).ravel())
        stop = lengths[at % n] * n + at % n  # the place behind the word's last
        node = np.zeros(len(at), np.int32)
        begins, ends, found = [], [], []
        for size in range(1, self.longest + 1):
            node = self.step(node, flat[at + (size - 1) * n])
            piece = self.piece[node]
            if size == 1:
                piece = np.where((node == 0) | (piece < 0), self.unknown, piece)
            hit = np.flatnonzero((piece >= 0) & ((node > 0) | (size == 1)))
            begins.append(at[hit])
            ends.append(at[hit] + size * n)
            found.append(piece[hit])
            on = np.flatnonzero((node > 0) & (at + size * n < stop))
            if not len(on):
                break
            at, stop, node = at[on], stop[on], node[on]
        return np.concatenate(begins), np.concatenate(ends), np.concatenate(found)


def swept(fixed: np.ndarray, to: np.ndarray, prob: np.ndarray, n: int, width: int, first: np.ndarray, reach: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all ways, place by place, and the logs of their scales (both:
    width + 1, words, languages). Arc i adds the sum at ``fixed[i]`` times
    ``prob[i]`` to the one at ``to[i]``; arcs are sorted by ``to`` (descending
    when ``back``). ``first`` starts the sums; ``reach``: characters of an arc."""
    langs = prob.shape[1]
    sums, scale, now = first, np.zeros((width + 1, n, langs)), None
    flat = sums.reshape(-1, langs)
    order = range(width - 1, -1, -1) if back else range(1, width + 1)
    level = to // n
    cuts = np.searchsorted(-level if back else level, [-j for j in order] if back else list(order), "left")
    cuts = np.append(cuts, len(to))
    for i, j in enumerate(order):
        low, high = cuts[i], cuts[i + 1]
        if now is not None:
            scale[j] = now
        if low < high:
            places = to[low:high]
            turn = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
            flat[places[turn]] += np.add.reduceat(flat[fixed[low:high]] * prob[low:high], turn, axis=0)
        if i % CHECK == CHECK - 1:
            here = sums[j]
            weak = (here > 0) & (here < SMALL)
            if weak.any():
                factor = np.where(weak, 1 / np.where(weak, here, 1), 1.0)
                window = slice(j, min(width, j + reach) + 1) if back else slice(max(0, j - reach), j + 1)
                sums[window] *= factor
                scale[window] -= np.log(factor)
                now = scale[j].copy()
    return sums, scale


def forward(lattice: Lattice, points: np.ndarray, lengths: np.ndarray, prob: np.ndarray, before: np.ndarray | None = None) -> tuple:
    """Forward sums, their log scales and the arcs (begin, end, piece) sorted by
    end. ``before``: the sums at the first places (all but the last of them are
    only arcs' beginnings)."""
    width, n = points.shape
    begin, end, piece = lattice.edges(points, lengths)
    given = 1 if before is None else len(before)
    order = np.argsort(end, kind="stable")
    order = order[end[order] >= given * n]
    begin, end, piece = begin[order], end[order], piece[order]
    first = np.zeros((width + 1, n, prob.shape[1]))
    first[:given] = 1 if before is None else before
    return *swept(begin, end, prob[piece], n, width, first, lattice.longest), begin, end, piece


def word_scores(lattice: Lattice, points: np.ndarray, lengths: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language."""
    sums, scale, *_ = forward(lattice, points, lengths, prob)
    rows = np.arange(len(lengths))
    return np.log(sums[lengths, rows]) + scale[lengths, rows]


def long_score(lattice: Lattice, points: np.ndarray, prob: np.ndarray, step: int = LONG) -> np.ndarray:
    """Log-probability of one word in each language, through a window."""
    before, base = np.ones((1, 1, prob.shape[1])), np.zeros(prob.shape[1])
    for at in range(0, len(points), step):
        low, high = max(0, at - len(before) + 1), min(len(points), at + step)
        part = points[low:high, None]
        sums, scale, *_ = forward(lattice, part, np.array([len(part)]), prob, before)
        base = base + scale[-1, 0] + np.log(sums[-1, 0])
        kept = min(len(part), lattice.longest - 1) + 1
        before = sums[-kept:] / sums[-1] * np.exp(scale[-kept:] - scale[-1])
    return base


def expected(lattice: Lattice, points: np.ndarray, lengths: np.ndarray, prob: np.ndarray, weight: np.ndarray, pieces: int) -> np.ndarray:
    """Expected counts (pieces, languages) of words seen ``weight`` times in
    each language: forward times backward over the whole."""
    width, n = points.shape
    langs, rows = weight.shape[1], np.arange(n)
    ahead, up, begin, end, piece = forward(lattice, points, lengths, prob)
    order = np.argsort(-begin, kind="stable")
    last = np.zeros((width + 1, n, langs))
    last[lengths, rows] = 1
    back, down = swept(end[order], begin[order], prob[piece[order]], n, width, last, lattice.longest, back=True)
    whole, log_whole = ahead[lengths, rows], up[lengths, rows]
    out, row = np.zeros((pieces, langs)), begin % n
    share = ahead.reshape(-1, langs)[begin] * prob[piece] * back.reshape(-1, langs)[end] / whole[row] * weight[row]
    if up.any() or down.any():
        share *= np.exp(up.reshape(-1, langs)[begin] + down.reshape(-1, langs)[end] - log_whole[row])
    for k in range(langs):
        out[:, k] = np.bincount(piece, share[:, k], pieces)
    return out


def words_of(column: pa.Array) -> tuple[np.ndarray, Callable[[np.ndarray], list[str]], np.ndarray, np.ndarray]:
    """Hashes of the distinct words, their texts by index, the word of each
    occurrence and each text's first one."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_spans(data, offsets, SPACE)
    hashes = hash_spans(data, starts, ends)
    codes, distinct = pd.factorize(hashes)
    where = np.empty(len(distinct), np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    raw = data.tobytes()

    def texts(index: np.ndarray) -> list[str]:
        own = where[index]
        return [raw[s:e].decode("utf-8", "replace").lower() for s, e in zip(starts[own].tolist(), ends[own].tolist())]

    return np.asarray(distinct, np.uint64), texts, codes, first


def grouped(words: list[str], longest: int = LONG) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points (characters, words), lengths and numbers of words (the mark in
    front) of like length; one of more than ``longest`` characters comes alone."""
    texts = [MARK + w for w in words]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        # So many that they fill CELLS places, at the length of the longest of them.
        to = at + 1
        while to < len(order) and sizes[order[to]] <= longest and (to - at + 1) * sizes[order[to]] <= CELLS and sizes[order[to]] <= 2 * sizes[order[at]] + 8:
            to += 1
        own = order[at:to]
        lengths = sizes[own]
        flat = np.frombuffer("".join([texts[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        points = np.zeros((len(own), int(lengths.max())), np.int64)
        points[np.arange(points.shape[1]) < lengths[:, None]] = flat
        yield np.ascontiguousarray(points.T), lengths, own
        at = to


class Model:
    def __init__(self, path: str, languages: list[str], prob: np.ndarray):
        self.path, self.languages, self.prob = path, languages, prob
        self.lattice: Lattice | None = None

    def __getstate__(self):
        return {"path": self.path, "languages": self.languages, "prob": self.prob}

    def __setstate__(self, state):
        self.__dict__.update(state, lattice=None)

    def ready(self) -> "Model":
        if self.lattice is None:
            self.lattice = _lattice(self.path)
            self.known, self.kept = np.zeros(0, np.uint64), np.zeros((0, len(self.languages)))
        return self

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability (words, languages)."""
        out = np.zeros((len(words), len(self.languages)))
        for points, lengths, own in grouped(words):
            out[own] = long_score(self.lattice, points[:, 0], self.prob) if len(points) > LONG else word_scores(self.lattice, points, lengths, self.prob)
        return out

    def of_hashes(self, hashes: np.ndarray, words) -> np.ndarray:
        """Scores of distinct words by their hashes: from those kept, and of
        ``words(indices)`` where they are new."""
        place = np.searchsorted(self.known, hashes)
        hit = np.zeros(len(hashes), bool)
        ok = place < len(self.known)
        hit[ok] = self.known[place[ok]] == hashes[ok]
        out, new = np.empty((len(hashes), len(self.languages))), np.flatnonzero(~hit)
        out[hit] = self.kept[place[hit]]
        out[new] = self.scores(words(new))
        afresh = len(self.known) + len(new) > KEEP
        known, kept = (hashes[new], out[new]) if afresh else (np.concatenate([self.known, hashes[new]]), np.concatenate([self.kept, out[new]]))
        order = np.argsort(known)
        self.known, self.kept = known[order][:KEEP], kept[order][:KEEP]
        return out


_lattices: dict[str, Lattice] = {}


def _lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(pieces_of(path))
    return _lattices[path]


def sampled(labelled: DataFrame, rows: int) -> DataFrame:
    """Different texts of each language, about ``rows`` divided by the number of
    languages of each, drawn by a hash of the text; (lang, text)."""
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(draw, 0.02).alias("texts"))
    share = F.lit(rows) / F.count("*").over(Window.partitionBy())  # over the languages, a handful of rows
    rate = counts.select(F.col("lang").alias("of"), F.ceil(F.least(F.lit(1.0), share / F.col("texts")) * (1 << 30)).alias("below"))
    own = labelled.withColumn("draw", draw).join(F.broadcast(rate), F.col("lang") == F.col("of")).filter(F.col("draw") < F.col("below"))
    return own.select("lang", "text").distinct()


def fit(labelled: DataFrame, path: str, rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Learn from ``labelled`` (text, lang). Of more than about ``rows`` different
    texts a sample is used; the piece counts of each task come to the driver,
    pieces times languages in size."""
    sample = saved(sampled(labelled.filter("text is not null and lang is not null").select("text", "lang"), rows), "language-sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    lattice = _lattice(path)
    size = lattice.unknown + 1
    prob = np.full((size, max(1, len(languages))), 1.0 / size)
    if not languages:
        return Model(path, [], prob)
    for _ in range(rounds):
        model = Model(path, languages, prob)

        def count(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            model.ready()
            total = np.zeros((size, len(languages)))
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    hashes, texts, codes, first = words_of(part.column("text"))
                    lang = np.array([languages.index(x) for x in part.column("lang").to_pylist()])
                    weight = np.zeros((len(hashes), len(languages)))
                    np.add.at(weight, (codes, np.repeat(lang, np.diff(first))), 1)
                    words, owner = [], []
                    for i, w in enumerate(texts(np.arange(len(hashes)))):
                        for at in range(0, len(w), LONG - 1):
                            words.append(w[at : at + LONG - 1])
                            owner.append(i)
                    for points, lengths, own in grouped(words):
                        total += expected(model.lattice, points, lengths, model.prob, weight[np.array(owner)[own]], size)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

        # Summed in a fixed order, so that every run gives the same model.
        found = sample.mapInArrow(count, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum(F.col("n").cast("decimal(30,12)")).cast("double").alias("n")).toPandas()
        total_counts = np.full((size, len(languages)), SMOOTH)
        total_counts[found["piece"], found["lang"]] += found["n"]
        prob = total_counts / total_counts.sum(axis=0)
    return Model(path, languages, prob)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the language's posterior per word, that is
    the softmax of the mean log-probabilities) of each whole text."""
    lettered = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.ready()
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                best, score = np.full(n, len(model.languages)), np.zeros(n)
                ok = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                if model.languages and ok.any():
                    hashes, texts, codes, first = words_of(part.column("text"))
                    each = model.of_hashes(hashes, texts)[codes]
                    total = np.vstack([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)])
                    sums = total[first[1:]] - total[first[:-1]]
                    mean = sums / np.maximum(np.diff(first), 1)[:, None]
                    share = np.exp(mean - mean.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    best[ok] = sums.argmax(axis=1)[ok]
                    score[ok] = share[np.arange(n), sums.argmax(axis=1)][ok]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return lettered.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 4; -1 for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)), F.lit(-1))
