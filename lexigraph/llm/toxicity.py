"""Toxicity by a classifier chain of linear models.

The chain's categories are what the labels hold, from the general to the specific:
poor quality, then toxicity. They are predicted one after another; each link sees
whole words and word beginnings that tell its category (their presence, or their
rate, so that inflected and compound forms count too), four measures of the text's
shape, and the log-odds of all earlier categories. The last link decides. For training,
earlier log-odds come from out-of-fold predictions, so a later link learns from
probabilities as good as it will meet: for each fold both the features and the
weights come from the other folds alone.

The models are fitted on at most about ``FIT_ROWS`` labelled rows, chosen by a
hash of doc_id (several labels of one doc_id count as their most severe). Rows of one label
whose sets of words and beginnings are equal
count once, the one with the least doc_id; near copies (by min-hashes) all count,
but in one fold and as one row of a feature's support, lest a group of copies
teach its own words. A link's words are
chosen by the strength of their association with its label inside a language
(``lang``, where there is one) or over all, against that language's own share of
the label and with room for each; a word that clean texts hold by chance, once,
still tells by its rate. The strengths are counted over the whole sample by
Spark; only values of chosen features reach the driver. Every whole text is scored.

Null text is empty and gets the base rates; repeated rows get equal rows; with
no labelled rows, or one class only, a category's model is its base rate and
nothing is toxic; an
empty table gives no rows; extra columns are left aside or, by ``clean``, kept.
Ties in word choice go by the word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLDED_VALUES, MIX, hash_spans, mix, saved, slices, text_buffer, word_spans
from .decontam import WORD

FIT_ROWS = 10_000
#: Words of one link that one language, and all together, can give: a bound on the model's size.
WORDS = 96
ALL_WORDS = 384
#: Lengths of word beginnings, in characters; WHOLE stands for the whole word.
BEGINNINGS = (4, 5, 6, 8)
WHOLE = 15
#: A feature's low bits: the length, then the kind (presence or rate).
RATE = 16
#: Words added to a text's length in rates, so that one word of a short text is no high rate.
SHRINK = 50
#: Rows of the sample that a word needs, in nearly as many groups of near copies.
SUPPORT = 8
#: Min-hashes that all agree in near copies.
SKETCH = 6
FOLDS = 5
RIDGE = 0.05
#: Standard deviations above chance that a feature needs: some hundred thousand are tried.
STRENGTH = 6.0
#: Or, for presence, minus the log of a bound on the chance of so many labelled
#: rows (Chernoff); where the label is common, deviations can't get that large.
SURPRISE = 14.0
#: From the general to the specific: name and label condition.
CATEGORIES = (("poor", "quality = 0"), ("toxic", "toxic = 1"))
#: Measures of a text's shape.
SHAPE = 4


def beginnings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (signed, the length in its low bits) and text of every word and word
    beginning, the words of each text, and its shape: how many words (log), their
    share of its bytes, how many repeat the one before, and their mean length."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_spans(data, offsets, WORD)
    sizes = np.diff(first)
    shape = np.zeros((len(sizes), SHAPE))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sizes, shape
    inner = np.concatenate([[0], np.cumsum(ends - starts)])
    inner = inner[first[1:]] - inner[first[:-1]]
    shape[:, 0] = np.log1p(sizes) / 10
    shape[:, 1] = inner / np.maximum(np.diff(offsets), 1)
    shape[:, 3] = inner / np.maximum(sizes, 1) / 10
    owner = np.repeat(np.arange(len(offsets) - 1), sizes)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.append(chars, np.full(max(BEGINNINGS) + 1, len(data)))
    at = np.searchsorted(chars, starts)
    hashes, texts = [], []
    for k in (*BEGINNINGS, WHOLE):
        stop = ends if k == WHOLE else chars[np.minimum(at + k, len(chars) - 1)]
        use = stop <= ends
        h = hash_spans(data, starts[use], stop[use], FOLDED_VALUES)
        if k == WHOLE:
            again = np.append(False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
            shape[:, 2] = np.bincount(owner, again, len(sizes)) / np.maximum(sizes, 1)
        with np.errstate(over="ignore"):
            h = (h + MIX[k]) * MIX[0]
        hashes.append(((h ^ (h >> np.uint64(32))) & np.uint64(2**64 - 32) | np.uint64(k)).view(np.int64))
        texts.append(owner[use])
    return np.concatenate(hashes), np.concatenate(texts), sizes, shape


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ascending: hash, text and count."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    once = np.ones(len(hashes), bool)
    once[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(once)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def sketches(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A key of each text's set of hashes (from ``cuts[i]`` to ``cuts[i + 1]``)
    that near copies are likely to share and others are not."""
    out, full = np.zeros(len(cuts) - 1, np.uint64), np.flatnonzero(np.diff(cuts))
    with np.errstate(over="ignore"):
        for j in range(SKETCH if len(full) else 0):
            least = np.minimum.reduceat(mix(hashes.view(np.uint64) ^ MIX[j]), cuts[full])
            out[full] = mix(out[full] + least)
    return out.view(np.int64)


def rate(counts, sizes, log1p=np.log1p):
    """The rate feature of a word seen ``counts`` times: bounded by log(1001)."""
    return log1p(1000 * counts / (sizes + SHRINK))


def measured(hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Values (texts, features) from all words' hashes and texts."""
    x = np.zeros((len(sizes), len(features)))
    if not len(features) or not len(hashes):
        return x
    known = np.unique(features & ~RATE)
    # Nearly all words are none of these; their first 16 bits tell most of that.
    begin, shift = np.zeros(1 << 16, bool), np.uint64(48)
    begin[known.view(np.uint64) >> shift] = True
    may = np.flatnonzero(begin[hashes.view(np.uint64) >> shift])
    hit = may[known[np.minimum(np.searchsorted(known, hashes[may]), len(known) - 1)] == hashes[may]]
    hashes, owner, counts = counted(hashes[hit], owner[hit])
    for kind, values in ((0, np.ones(len(counts))), (RATE, rate(counts, sizes[owner]))):
        place = np.minimum(np.searchsorted(features, hashes | kind), len(features) - 1)
        own = np.flatnonzero(features[place] == hashes | kind)
        x[owner[own], place[own]] = values[own]
    return x


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept, unpenalised) by Newton's method,
    steps halved until they lower the loss."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    loss = lambda v: np.logaddexp(0, (1 - 2 * y) * (x1 @ v)).sum() + (penalty * v * v).sum() / 2
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(h, x1.T @ (y - p) - penalty * w)
        while (after := loss(w + step)) > now and np.abs(step).max() >= 1e-6:
            step /= 2
        if np.abs(step).max() < 1e-6:
            break
        w, now = w + step, after
    return w


class Chain:
    """The words (ascending), one weight vector for each category (words, shape,
    earlier log-odds, intercept), and the log-odds of the last from which a text
    counts as toxic."""

    def __init__(self, names: list[str], words: np.ndarray, weights: list[np.ndarray], cut: float = 0.0):
        self.names, self.words, self.weights, self.cut = names, words, weights, cut

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds (rows, categories), each fed to the next."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            full = np.hstack([x, out])
            out = np.hstack([out, np.clip(full @ w[:-1] + w[-1], -30, 30)[:, None]])
        return out

    def features(self, column: pa.Array) -> np.ndarray:
        hashes, owner, sizes, shape = beginnings(column)
        return np.hstack([measured(hashes, owner, sizes, self.words), shape])

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (rows, categories), and which texts are toxic."""
        margins = self.margins(self.features(column))
        return 1 / (1 + np.exp(-margins)), margins[:, -1] >= self.cut


def best_cut(margins: np.ndarray, y: np.ndarray) -> float:
    """Where out-of-fold margins part the classes best by F1; amid the gap."""
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(y[order])
    ends = np.append(m[:-1] > m[1:], True)
    score = np.where(ends, 2 * hits / (np.arange(1, len(m) + 1) + y.sum()), -1)
    k = int(score.argmax())
    return float(m[k] - 1 if k + 1 == len(m) else (m[k] + m[k + 1]) / 2)


def fit_arrays(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, chosen: list[list[np.ndarray]] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """One weight vector for each column of ``labels``, and the out-of-fold
    log-odds (rows, categories), on which the later ones are fitted.
    ``chosen[m][k]``: the columns of ``x`` that link k may use when fold m is
    left out, or, at the end, when none is; without it all columns."""
    chosen = chosen or [[np.arange(x.shape[1])] * labels.shape[1]] * (FOLDS + 1)
    known, weights = np.zeros((len(x), 0)), []
    for k in range(labels.shape[1]):
        y, own = labels[:, k], chosen[-1][k]
        w = logistic(np.hstack([x[:, own], known]), y)
        full = np.zeros(x.shape[1] + k + 1)
        full[own], full[x.shape[1] :] = w[: len(own)], w[len(own) :]
        weights.append(full)
        held = np.zeros(len(x))
        for f in range(FOLDS):
            out, seen = fold == f, np.hstack([x[:, chosen[f][k]], known])
            w = logistic(seen[~out], y[~out])
            held[out] = seen[out] @ w[:-1] + w[-1]
        known = np.hstack([known, np.clip(held, -30, 30)[:, None]])
    return weights, known


def training(docs: DataFrame, labels: DataFrame, categories, rows: int) -> DataFrame:
    """The sample: doc_id, lang, fold, alike, size, shape, words, counts and a
    column of each category."""
    ys = [f"y{i}" for i in range(len(categories))]
    conditions = [F.max(F.coalesce(F.expr(c), F.lit(False)).cast("double")).alias(y) for y, (_, c) in zip(ys, categories)]
    truth = labels.filter("doc_id is not null")
    total = truth.select(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    if total > rows:
        truth = truth.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / total))
    truth = truth.groupBy("doc_id").agg(*conditions)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    # About ``rows`` rows of a few numbers each; Spark knows their size from the written table.
    truth = saved(truth, "toxicity-labels")
    joined = docs.filter("text is not null").select("doc_id", lang.alias("lang"), "text").join(truth, "doc_id")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, owner, sizes, shape = beginnings(part.column("text"))
                hashes, owner, counts = counted(hashes, owner)
                cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(v)) for v in (hashes, counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(sizes), pa.array(list(shape), pa.list_(pa.float64())), pa.array(sketches(hashes, cuts)), *lists, *(part.column(y) for y in ys)], names=["doc_id", "lang", "size", "shape", "alike", "words", "counts", *ys])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, size long, shape array<double>, alike long, words array<long>, counts array<long>, " + ", ".join(f"{y} double" for y in ys)
    sample = one_of_equals(joined.mapInArrow(listed, schema), ys)
    return saved(sample.withColumn("fold", F.pmod("alike", F.lit(FOLDS)).cast("int")), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, rows: int = FIT_ROWS, words: int = WORDS) -> Chain:
    """Learn the chain from the rows of ``docs`` that ``labels`` covers."""
    return fitted(docs, labels, categories, rows, words)[0]


def fitted(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, rows: int = FIT_ROWS, words: int = WORDS) -> tuple[Chain, dict[str, np.ndarray]]:
    """The chain, and of each row of the sample its doc_id, lang, labels (rows,
    categories) and out-of-fold log-odds."""
    names, ys = [n for n, _ in categories], [f"y{i}" for i in range(len(categories))]
    sample = training(docs, labels, categories, rows)
    if sample.isEmpty():
        none = np.zeros((0, len(names)))
        return Chain(names, np.zeros(0, np.int64), [np.array([0.0] * (SHAPE + i) + [-30.0]) for i in range(len(names))], np.inf), {"doc_id": none[:, 0], "lang": none[:, 0], "labels": none, "margins": none}
    counts = saved(word_counts(sample, ys), "toxicity-words")
    found = chosen_words(counts, sample, ys, words)
    every = np.unique(np.concatenate([w for one in found for w in one]))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, times = batch.column("words"), batch.column("counts").flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            x = measured(np.repeat(lists.flatten().to_numpy(), times), np.repeat(owner, times), batch.column("size").to_numpy(), every)
            x = np.hstack([x, np.array(batch.column("shape").to_pylist()).reshape(len(x), SHAPE)]).astype("<f4")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "alike", "lang", "fold", *ys)), pa.array([row.tobytes() for row in x], pa.binary())], names=["doc_id", "alike", "lang", "fold", *ys, "x"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, alike long, lang string, fold int, " + ", ".join(f"{y} double" for y in ys) + ", x binary"
    # A bounded sample, with the values of a bounded number of words.
    rows_ = sample.select("doc_id", "alike", "lang", "fold", "size", "shape", "words", "counts", *ys).mapInArrow(valued, schema).orderBy("doc_id", "alike", *ys).toPandas()
    x = np.frombuffer(b"".join(rows_.pop("x")), "<f4").reshape(len(rows_), -1)
    shape = np.arange(len(every), x.shape[1])
    columns = [[np.append(np.searchsorted(every, w), shape) for w in one] for one in found]
    truths = rows_[ys].to_numpy(float)
    weights, margins = fit_arrays(x, truths, rows_["fold"].to_numpy(), columns)
    # Without a telling word all texts have the base rates, and none is toxic.
    cut = best_cut(margins[:, -1], truths[:, -1]) if truths[:, -1].any() and len(found[-1][-1]) else np.inf
    used = np.unique(np.concatenate(found[-1]))
    at = np.append(np.searchsorted(every, used), shape)
    weights = [np.append(w[at], w[x.shape[1] :]) for w in weights]
    return Chain(names, used, weights, cut), {"doc_id": rows_["doc_id"].to_numpy(), "lang": rows_["lang"].to_numpy(), "labels": truths, "margins": margins}


def one_of_equals(sample: DataFrame, ys: list[str]) -> DataFrame:
    """Of rows with the same words and labels the one with the least doc_id."""
    same = Window.partitionBy(F.sha2(F.array_join("words", ","), 256), *ys).orderBy("doc_id", "lang", "size", F.xxhash64("counts"))
    return sample.withColumn("copy", F.row_number().over(same)).filter("copy = 1").drop("copy")


def word_counts(sample: DataFrame, ys: list[str]) -> DataFrame:
    """For each fold, language and word: rows, groups of near copies (bits), and
    sums of its rates, their squares and both in each label's rows; of words in
    as many rows as any choice asks for."""
    enough = sample.select(F.explode("words").alias("often")).groupBy("often").agg(F.count("*").alias("n")).filter(F.col("n") >= (1 - 1 / FOLDS) * SUPPORT).select("often")
    enough = saved(enough, "toxicity-often")
    one = sample.select("fold", "lang", "size", "alike", *ys, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("row"), F.explode(F.arrays_zip("words", "counts")).alias("w"))
    one = one.select("fold", "lang", "row", "alike", *ys, F.col("w.words").alias("word"), rate(F.col("w.counts"), F.col("size"), F.log1p).alias("v"))
    one = one.join(enough, F.col("word") == F.col("often"), "left_semi")
    sums = [F.sum("v").alias("v1"), F.sum(F.col("v") * F.col("v")).alias("v2"), *(F.sum(y).alias(f"n_{y}") for y in ys), *(F.sum(F.col(y) * F.col("v")).alias(f"v_{y}") for y in ys)]
    # Groups of near copies are told apart by one of 64 bits each.
    bit = F.expr("bit_or(shiftleft(1L, cast(pmod(alike, 64) as int)))")
    return one.groupBy("fold", "lang", "word").agg(F.count("*").alias("n"), bit.alias("bits"), F.sum("row").alias("rows"), *sums)


def chosen_words(counts: DataFrame, sample: DataFrame, ys: list[str], words: int) -> list[list[np.ndarray]]:
    """For each fold that is left out, and at the end for none, for each label: the
    words, ascending, whose sum over its rows is well above
    what the label's share in each language lets expect; in one language or over
    all. Of words equal in all rows the longest is taken. What is asked of a word
    shrinks with the share of the sample that is seen."""
    least, most = 1e-3, 1 - 1e-3
    seen = lambda rows: rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).filter("model != fold")
    part = F.when(F.col("model") == FOLDS, 1.0).otherwise(1 - 1 / FOLDS)
    shares = [F.greatest(F.lit(least), F.least(F.lit(most), F.avg(y))).alias(f"p_{y}") for y in ys]
    base = seen(sample.select("fold", "lang", *ys)).groupBy("model", "lang").agg(*shares)
    names = ["n", "rows", "v1", "v2", *(f"{c}_{y}" for c in "nv" for y in ys)]
    own = seen(counts).groupBy("model", "lang", "word").agg(F.expr("bit_count(bit_or(bits))").alias("groups"), *(F.sum(c).alias(c) for c in names))
    own = own.filter(F.greatest(*(F.col(f"n_{y}") for y in ys), F.lit(0.0)) > 0).join(base, ["model", "lang"])
    kinds = []
    for label, y in enumerate(ys):
        for kind, first, second, name in ((0, F.col("n").cast("double"), F.col("n").cast("double"), "n"), (RATE, F.col("v1"), F.col("v2"), "v")):
            p, held = F.col(f"p_{y}"), F.col(f"{name}_{y}")
            kinds.append(F.struct(F.lit(label).alias("label"), F.col("word").bitwiseOR(F.lit(kind)).alias("word"), F.round(first, 6).alias("first"), (held - p * first).alias("o"), (p * (1 - p) * second).alias("e"), (p * first).alias("w")))
    each = own.select("model", "lang", "n", "groups", "rows", F.explode(F.array(*kinds)).alias("kind")).select("model", "lang", "n", "groups", "rows", "kind.*")
    z = F.when((F.col("e") > 0) & (F.col("o") > 0), F.col("o") / F.sqrt("e")).otherwise(0.0)
    enough = (F.col("n") >= part * SUPPORT) & (F.col("groups") >= part * SUPPORT - 1)
    each = each.withColumn("z", F.when(enough, z).otherwise(0.0))
    pooled = each.groupBy("model", "label", "word").agg(F.max_by("lang", F.struct("z", "n", "lang")).alias("lang"), F.max("z").alias("top"), *(F.sum(c).alias(c) for c in ("n", "groups", "rows", "first", "o", "e", "w")))
    n, k = F.col("n"), F.col("w") + F.col("o")
    rest = F.when(n - k > 1e-6, (n - k) * F.log((n - k) / (n - F.col("w")))).otherwise(0.0)
    bound = F.when(F.col("o") > 0, k * F.log(k / F.col("w")) + rest).otherwise(0.0)
    unlikely: Column = (F.col("word").bitwiseAND(F.lit(RATE)) == 0) & (bound >= part * SURPRISE)
    strong = pooled.filter(enough).withColumn("z", F.greatest("top", z)).filter((F.col("z") >= F.sqrt(part) * STRENGTH) | unlikely)
    # Equal in all rows: the same rows (by their hashes' sum) and the same sum of values.
    kind = F.col("word").bitwiseAND(F.lit(RATE))
    strong = strong.withColumn("length", F.col("word").bitwiseAND(F.lit(RATE - 1)))
    same = Window.partitionBy("model", "label", kind, "n", "rows", F.round("first", 5)).orderBy(F.desc("length"), "word")
    ranked = strong.withColumn("twin", F.row_number().over(same)).filter("twin = 1").withColumn("rank", F.row_number().over(Window.partitionBy("model", "label", "lang").orderBy(F.desc("z"), "word")))
    # At most ``words`` of each language and label.
    found = ranked.filter(F.col("rank") <= words).select("model", "label", "rank", "z", "word").collect()
    best = [[sorted((r["rank"], -r["z"], r["word"]) for r in found if (r["model"], r["label"]) == (m, i))[:ALL_WORDS] for i in range(len(ys))] for m in range(FOLDS + 1)]
    return [[np.sort(np.array([w for *_, w in one], np.int64)) for one in model] for model in best]


def score(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, p_<category> of each and the boolean toxic."""
    names = [f"p_{n}" for n in chain.names]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p, toxic = chain.judge(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(p[:, i]) for i in range(len(names))), pa.array(toxic)], names=[*keep, *names, "toxic"])

    columns = list(dict.fromkeys([*keep, "text"]))
    return docs.select(columns).mapInArrow(run, f"{fields}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(~chain.judge(part.column("text"))[1]))

    return docs.mapInArrow(run, docs.schema)
