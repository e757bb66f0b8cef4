"""Toxicity, secrets, join, sharding, language and the pipeline."""

import collections
import fractions
import hashlib
import importlib.util
import math
import random
import re
import statistics
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from lexigraph.llm import langid, ngram_join, secret_scan, sharding, toxicity  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None, sources=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# Secrets

ASSIGN = re.compile(secret_scan.BASE[0][1], re.A)
SECRETS = [
    None, "", "password=hunter2", "Password: 'abc'", 'api_key = "k/x+y=z.."', "secret: token = abcdefgh", "apikey:short", "x token=a1b2c3d4 TOKEN='Zyxwvu'", "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 9, "AKIA" + "B" * 15,
    "deadbeef" * 3, "deadbee" * 3, "é🙂 password=éé secret=ABCDEF🙂 " + "0123456789abcdef" * 2, "passwdpasswd::abcdef", "token" * 30, "0" * 40, "key AbC9xQ2LmZ8tR4vW1yUuK7 end", "a" * 3000,
]


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_equal_the_patterns(spark):
    rows = docs(spark, SECRETS)
    out = {r["doc_id"]: r for r in secret_scan.secret_report(rows).collect()}
    for i, t in enumerate(SECRETS):
        spans = base_spans(t or "")
        said = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert [out[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[1] == k for x in spans) for k in range(3)], t
        assert out[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(out[i]["spans"].split(","))
    assert secret_scan.secret_report(rows.filter("false")).count() == 0


def battery(token):
    """Score of a run, by sums over its characters and the library's normal law."""
    for _, pattern, alphabet in secret_scan.ENCODINGS:
        if re.search(pattern, token):
            break
    else:
        return 0.0
    v = [alphabet.index(c) for c in token.rstrip("=")]
    n, k = len(v), len(alphabet)
    normal = statistics.NormalDist()
    chi = sum((c - n / k) ** 2 / (n / k) for c in (v.count(i) for i in range(k)))
    df = (k - 1) * n / (n - 1)
    p_chi = 1 - normal.cdf(((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * df)) / (2 / (9 * df)) ** 0.5)
    ups = [x >= k / 2 for x in v]
    runs, one = 1 + sum(a != b for a, b in zip(ups, ups[1:])), sum(ups)
    mean = 2 * one * (n - one) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = 2 * normal.cdf(-abs(runs - mean) / var**0.5) if var > 0 else 0.0
    centred = np.array(v) - np.mean(v)
    total = (centred**2).sum()
    r = (centred * np.roll(centred, -1)).sum() / total if total else 0
    p_serial = 2 * normal.cdf(-abs(r + 1 / (n - 1)) * (n - 1) * (n - 2) ** 0.5 / n) if total else 0.0
    return 1 - (1 - min(p_chi, p_runs, p_serial)) ** 3


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_statistics_equal_an_independent_version(spark):
    draw = random.Random(31)
    tokens = ["".join(draw.choice(s) for _ in range(draw.randrange(20, 90))) for s in (LETTERS, LETTERS[:26], LETTERS[26:], LETTERS[26:52], "ABCDEF0123456789", LETTERS + "+/", LETTERS + "-_", "xy") for _ in range(12)]
    tokens += ["covid19vaccinationprogramme2021", "the_quick_brown_fox_jumps_over", "A" * 30, "thequickbrownfoxjumpsover==", "a+b_c-d/" * 4]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string")
    found = rows.select("t", F.explode(secret_scan.tested_runs(F.col("t"), F.expr(secret_scan.NO_SPANS))).alias("x")).select("t", "x.p").collect()
    assert len(found) == len(tokens)
    for r in found:
        assert r["p"] == pytest.approx(battery(r["t"]), abs=2e-6), r["t"]


def test_tail_of_small_samples():
    """The chi-squared tail against drawn samples, where the plain normal law fails."""
    draw = np.random.default_rng(1)
    for n, k in ((20, 16), (20, 36), (24, 64), (64, 62)):
        counts = draw.multinomial(n, [1 / k] * k, 40_000)
        chi = (counts.astype(float) ** 2).sum(axis=1) * k / n - n
        df, normal = (k - 1) * n / (n - 1), statistics.NormalDist()
        for q in (0.9, 0.99):
            at = np.quantile(chi, q)
            p = 1 - normal.cdf(((at / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * df)) / (2 / (9 * df)) ** 0.5)
            share = (chi >= at).mean()
            assert 0.4 * share < p < 2.5 * share, (n, k, q)


def prose(draw, n):
    parts = ["the", "ing", "tion", "wh", "and", "er", "re", "on", "at", "ble", "ment", "ly", "es", "ha"]
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randrange(1, 4))) for _ in range(n))


def test_reported_runs_are_controlled(spark):
    """Random keys among glued words: found, with hardly any words; one odd
    identifier alone in ordinary text is left alone."""
    draw = random.Random(8)
    real = ["".join(draw.choice(LETTERS) for _ in range(draw.choice([24, 32, 40, 64]))) for _ in range(120)]
    plain = ["the_quick_brown_fox_jumps_over_lazy_dog_" + str(i) for i in range(30)] + ["Z" * 30 + str(i) for i in range(30)] + ["xyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxy%d" % i for i in range(30)]
    plain += [prose(draw, draw.randrange(6, 12)).replace(" ", draw.choice(["", "_", "-"])) for _ in range(400)]
    plain = [p for p in plain if len(p) >= 20]
    planted = [f"{prose(draw, 90)} see {t} here" for t in real + plain]
    texts = planted + [prose(draw, 150) for _ in range(800)]
    out = {r["doc_id"]: r["spans"] for r in secret_scan.secret_report(docs(spark, texts)).collect()}
    found = [bool(out[i]) for i in range(len(texts))]
    assert sum(found[: len(real)]) >= 95
    assert sum(found[len(real) :]) <= 0.05 * sum(found)
    for i, t in enumerate(real):
        at = planted[i].index(t)
        assert out[i] in ("", f"random:{at}:{at + len(t)}") or "hex" in out[i]
    alone = [prose(draw, 150) for _ in range(800)] + ["covid19vaccinationprogramme2021 began"]
    assert secret_scan.secret_report(docs(spark, alone)).filter("spans != ''").count() == 0


def test_ordinary_runs_are_made_of_all_words(spark):
    """Every word of a long text, not of a part of it, so one text is enough to tell keys from it."""
    draw = random.Random(12)
    texts = [None, "", "a b", "é" * 50, "x" * 25, "y" * 25 + " end", prose(draw, 9) + " " + "Q" * 30 + "\n" + prose(draw, 700), " ".join("abcde" for _ in range(900))]
    rows = docs(spark, texts)
    for r in rows.select("text", secret_scan.stretches(F.coalesce("text", F.lit(""))).alias("s")).collect():
        assert " ".join(r["s"]).split() == [w for w in re.findall("[A-Za-z0-9]+", r["text"] or "") if len(w) < 20]
    runs = [r["token"].lower() for r in secret_scan.ordinary_runs(rows.filter("doc_id = 7")).collect()]
    assert sum(t.count(c) for t in runs for c in "abcde") == 4500 and min(map(len, runs)) >= 20
    keys = ["".join(draw.choice(LETTERS) for _ in range(40)) for _ in range(20)]
    text = " ".join(f"{prose(draw, 300)} see {k} here" for k in keys)
    spans = secret_scan.secret_report(docs(spark, [text])).first()["spans"]
    assert sum(f"random:{text.index(k)}:{text.index(k) + 40}" in spans for k in keys) >= 15


def test_counts_up_to_the_cut_equal_the_whole_battery(spark):
    draw = random.Random(13)
    rows = docs(spark, [prose(draw, 200) for _ in range(40)] + [" ".join("".join(draw.choice(LETTERS) for _ in range(draw.randrange(1, 9))) for _ in range(200)) for _ in range(20)])
    token = F.struct(F.lit(0).alias("start"), F.length("token").alias("end"), "token")
    every = secret_scan.ordinary_runs(rows).select(F.explode(secret_scan.battery(F.array(token))).alias("x"))
    every = collections.Counter((r[0], r[1]) for r in every.select(secret_scan.class_of(F.col("x")), secret_scan.p_bin(F.col("x.p"))).collect())
    cuts = dict(enumerate(secret_scan.CUTS))
    found = {(r["class"], r["bin"]): r["ordinary"] for r in secret_scan.ordinary_counts(rows, cuts).collect()}
    assert sum(found.values()) == sum(every.values()) and any(b <= cuts[c] for c, b in every)
    assert {k: v for k, v in found.items() if k[1] <= cuts[k[0]]} == {k: v for k, v in every.items() if k[1] <= cuts[k[0]]}
    more = rows.unionAll(docs(spark, ["see " + "".join(draw.choice(LETTERS) for _ in range(40)) for _ in range(9)]))
    levels = [secret_scan.span_levels(more, 0.01, cuts) for cuts in ((0,) * 9, (secret_scan.BINS - 1,) * 9)]
    assert levels[0] == levels[1]


def test_columns_named_like_results(spark):
    rows = spark.createDataFrame([(1, "password=hunter2", "mine", "own"), (1, "password=hunter2", "mine", "own"), (None, None, None, "own")], "doc_id long, text string, spans string, base_spans string")
    assert sorted(map(str, map(tuple, secret_scan.redact(rows).collect()))) == sorted(map(str, [(1, "[SECRET]", "mine", "own")] * 2 + [(None, None, None, "own")]))
    assert secret_scan.find_secrets(rows).columns == ["doc_id", "text", "base_spans", "spans"]
    assert secret_scan.secret_report(rows).filter("doc_id = 1").select("spans").distinct().first()[0] == "assign:0:16"


def test_redaction(spark):
    rows = docs(spark, SECRETS)
    out = {r["doc_id"]: r for r in secret_scan.redact(rows).collect()}
    for i, t in enumerate(SECRETS):
        if not base_spans(t or ""):
            continue
        assert all(t[s:e] not in out[i]["text"] for s, _, e in base_spans(t)) and "[SECRET]" in out[i]["text"]
        assert out[i]["n_chars"] == len(out[i]["text"])
    assert out[0]["text"] is None and out[1]["text"] == ""
    assert secret_scan.redact(rows).columns == rows.columns


# Join

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute_join(rows):
    """doc_id, size and component of (doc_id, text) rows, by all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near(draw, words, rate):
    return [draw.choice(["q%d" % draw.randrange(10**6)]) if draw.random() < rate else w for w in words]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, monkeypatch, seed):
    draw = random.Random(seed)
    new = lambda n: ["w%d" % draw.randrange(10**6) for _ in range(n)]
    passage = new(60)
    texts = ["", None, " \t\n", "one", "ONE", "a b c d", "A  b\tc d", "a b c d e", "a b c d f", "a b c d e a b c d e a b c d e"]
    for size in (6, 7, 8, 9, 12, 20, 40, 90, 300):
        base = new(size)
        texts += [" ".join(base), " ".join(base)] + [" ".join(base[: size - k] + new(j)) for k in range(3) for j in range(3)]
        texts += [" ".join(near(draw, base, r)) for r in (0.01, 0.02, 0.03, 0.05) for _ in range(3)]
    # A chain, in which only neighbours link, a hot group and a shared passage.
    chain = new(120)
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 60, 4)]
    hot = new(50)
    texts += [" ".join(near(draw, hot, 0.02)) for _ in range(80)]
    texts += [" ".join(new(draw.randrange(5, 80)) + passage + new(draw.randrange(5, 80))) for _ in range(60)]
    rows = list(enumerate(texts))
    rows += [(3, "one"), (len(texts) + 1, texts[20])]
    draw.shuffle(rows)
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 30)
    table = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    assert sorted(map(tuple, ngram_join.components(table).collect())) == brute_join(rows)


def test_join_on_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.components(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, ""), (2, None)], "doc_id long, text string")
    assert sorted(map(str, map(tuple, ngram_join.components(rows).collect()))) == sorted(map(str, [(None, 2, 4), (4, 2, 4), (None, 0, None), (2, 0, 2)]))


def test_one_row_of_each_component_stays(spark):
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve", "a b c d e f g h"
    columns = "doc_id long, text string, print string"
    probe = [(3, b, "x"), (5, a, "x"), (5, b, "x"), (7, a, "x"), (9, a, "x"), (9, a, "x")]
    kept = lambda rows: sorted(map(str, map(tuple, ngram_join.one_of_each(spark.createDataFrame(rows, columns)).collect())))
    assert kept(probe) == sorted(map(str, [(3, b, "x"), (5, a, "x")]))
    assert kept([(4, a, "y"), (4, a, "x"), (4, a, "z")]) == [str((4, a, "x"))]
    assert kept([(None, a, "x"), (None, a.upper(), "x"), (None, b, None), (None, b, None), (2, c, "x"), (None, c, "x")]) in (
        sorted(map(str, [(None, t, "x"), (None, b, None), (2, c, "x")])) for t in (a, a.upper())
    )
    assert kept([(1, "", "x"), (1, None, "x"), (2, "", "x"), (2, None, "x")]) == sorted(map(str, [(1, "", "x"), (1, None, "x"), (2, "", "x"), (2, None, "x")]))
    assert kept([]) == []


def test_crowded_tiles_blocks_and_ranges_are_split(spark, monkeypatch):
    """Near copies of one text in many blocks: bounds lowered so that blocks,
    tiles and hash ranges all have several parts."""
    draw = random.Random(21)
    base = ["w%d" % draw.randrange(10**6) for _ in range(60)]
    texts = [" ".join(near(draw, base, draw.choice([0.02, 0.04, 0.06]))) for _ in range(150)]
    for name, value in (("BLOCK_SHINGLES", 300), ("BLOCK_SETS", 4), ("TILE_PAIRS", 3), ("RANGE_SHINGLES", 200)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.components(table).collect())) == brute_join(rows)


def test_light_and_heavy_paths_agree(spark, monkeypatch):
    draw = random.Random(9)
    texts = []
    for size in (8, 16, 30, 60, 120):
        base = ["w%d" % draw.randrange(10**6) for _ in range(size)]
        texts += [" ".join(near(draw, base, 0.02)) for _ in range(15)]
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_join(rows)
    for at in (2, 14, 40, 10**6):
        monkeypatch.setattr(ngram_join, "boundary", lambda found, at=at: at)
        assert sorted(map(tuple, ngram_join.components(table).collect())) == expected


# Sharding


def test_sharding(spark):
    draw = random.Random(10)
    n = 3000
    texts = [None if i % 50 == 0 else "é" * draw.randrange(30) for i in range(n)]
    sources = ["hot" if i % 3 else draw.choice(["a", "b", None]) for i in range(n)]
    rows = docs(spark, texts, sources=sources)
    rows = rows.union(rows.filter("doc_id < 5"))
    out = sharding.slots(rows, 7).collect()
    assert len(out) == n + 5
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    counts = collections.Counter(r["shard"] for r in out)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    mixture = collections.Counter((r["shard"], r["source"]) for r in out)
    total = collections.Counter(r["source"] for r in out)
    assert all(abs(mixture[s, k] - total[k] / 7) <= len(total) for s in range(7) for k in total)
    spots = sorted(((r["shard"], r["slot"], r["fraction"], r["source"] or "") for r in out))
    assert [x[2:] for x in spots] == sorted(x[2:] for x in spots)  # the order is that of the fractional ranks
    for k in total:
        assert sorted(r["fraction"] for r in out if r["source"] == k) == pytest.approx([(i + 0.5) / total[k] for i in range(total[k])])
    assert sharding.slots(rows.filter("false")).count() == 0
    assert sharding.slots(rows.limit(3), 7).count() == 3


def test_sharding_of_odd_rows(spark, monkeypatch):
    """Rows without doc_id, repeated ones, a long text, clashing columns; small slices."""
    monkeypatch.setattr(sharding, "SLICE_ROWS", 16)
    monkeypatch.setattr(sharding, "SLICES", 4)
    rows = [(None, "text %d" % i, None, "x", 1.5) for i in range(1000)] + [(5, "same", "a", "x", 1.5)] * 30 + [(6, "long " * 400_000, "a", "x", 1.5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, fraction double")
    out = sharding.slots(table, 24)
    assert out.count() == 1031 and out.filter("size = 2000008").count() == 1
    cells = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("slots")).collect()
    assert len(cells) == 24 and all(r["top"] + 1 == r["n"] == r["slots"] and r["n"] in (42, 43) for r in cells)
    slices = table.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit(1).alias("size")).filter("doc_id is null").select(F.floor(sharding.order_hash(11) / 16**sharding.DIGITS * 64).alias("s")).groupBy("s").count()
    assert slices.count() >= 60 and slices.agg({"count": "max"}).first()[0] < 45


# Toxicity


def test_toxicity(spark):
    draw = random.Random(11)
    bad, words = ["idiot", "scum", "moron"], ["w%d" % i for i in range(300)]
    texts, labels = [], []
    for i in range(900):
        t = [draw.choice(words) for _ in range(draw.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            t.insert(draw.randrange(len(t)), draw.choice(bad).upper())
        texts.append(" ".join(t))
        labels.append((i, draw.randrange(2), int(toxic)))
    texts += ["", None, "idiot", "clean words only", "w1 " * 50_000]
    rows = docs(spark, texts)
    chain = toxicity.fit(rows, spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int"))
    assert [len(w) for w in chain.weights] == [len(chain.words) + toxicity.SHAPE + k + 1 for k in range(2)]
    out = {r["doc_id"]: r for r in toxicity.score(rows, chain).collect()}
    assert all(out[i]["toxic"] == (i % 5 == 0) for i in range(900))
    assert out[902]["toxic"] and not any(out[i]["toxic"] for i in (900, 901, 903, 904))
    kept = toxicity.clean(rows, chain)
    assert kept.columns == rows.columns and kept.count() == 905 - 181
    none = toxicity.fit(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(rows, none).filter("toxic").count() == 0
    assert toxicity.score(rows.filter("false"), chain).count() == 0


def test_toxicity_of_rare_languages_shows_in_rates(spark):
    """Toxic texts of a second language hold compounds of one word again and
    again; many clean ones hold one by chance."""
    draw = random.Random(13)
    texts, langs, labels = [], [], []
    some = ["".join(draw.choice("abdegiklmnoprstu") for _ in range(7)) for _ in range(6000)]
    for i in range(900):
        second, toxic = i % 3 == 0, draw.random() < 0.15
        t = [("u" if second else "w") + draw.choice(some) for _ in range(draw.randrange(80, 160))]
        for _ in range((4 if toxic else draw.random() < 0.15) if second else int(toxic)):
            t.insert(draw.randrange(len(t)), f"achlich{draw.randrange(10**6)}" if second else draw.choice(["idiot", "scum", "moron"]))
        texts.append(" ".join(t))
        langs.append("de" if second else "en")
        labels.append((i, 1, int(toxic)))
    rows = docs(spark, texts, langs)
    chain = toxicity.fit(rows, spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int"))
    flagged = {r["doc_id"] for r in toxicity.score(rows, chain).filter("toxic").collect()}
    assert flagged >= {i for i, _, toxic in labels if toxic}
    assert len(flagged - {i for i, _, toxic in labels if toxic}) <= 3
    few = toxicity.fit(rows, spark.createDataFrame(labels[:20], "doc_id long, quality int, toxic int"))
    assert toxicity.score(rows, few).filter("toxic").count() == 0  # too few rows to find a feature


def test_labelled_rows_with_common_beginnings_all_count(spark, monkeypatch):
    """Different texts of few words, which share their least hashes, all stay;
    equal texts count once for each label."""
    draw, kept = random.Random(14), []
    texts = [" ".join(draw.choice(["w%d" % k for k in range(300)]) for _ in range(120)) for _ in range(200)]
    texts += [texts[0], texts[1]]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(200, 1, 1), (201, 1, 1)]
    equals = toxicity.one_of_equals
    monkeypatch.setattr(toxicity, "one_of_equals", lambda sample, ys: kept.append(equals(sample, ys)) or kept[0])
    toxicity.fit(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(r["doc_id"] for r in kept[0].select("doc_id").collect()) == [*range(200), 201]


def slow_chain(x, labels, fold):
    """Out-of-fold log-odds by minimising the loss anew for each link and fold."""
    known = np.zeros((len(x), 0))
    for y in labels.T:
        held = np.zeros(len(x))
        for f in range(toxicity.FOLDS):
            z = np.hstack([x, known, np.ones((len(x), 1))])
            w = np.zeros(z.shape[1])
            own, penalty = fold != f, np.append(np.full(z.shape[1] - 1, toxicity.RIDGE), 1e-6)
            for _ in range(4000):  # majorised steps: slow and sure
                p = 1 / (1 + np.exp(-(z[own] @ w)))
                w -= np.linalg.solve(z[own].T @ z[own] / 4 + np.diag(penalty), z[own].T @ (p - y[own]) + penalty * w)
            held[~own] = z[~own] @ w
        known = np.hstack([known, np.clip(held, -30, 30)[:, None]])
    return known


def test_chain_uses_out_of_fold_margins():
    draw = np.random.default_rng(12)
    x = draw.integers(0, 2, (400, 6)).astype(float)
    first = ((x[:, 0] > 0) ^ (draw.random(400) < 0.1)).astype(float)
    second = first * (draw.random(400) < 0.9)
    fold = np.arange(400) % 5
    weights, known = toxicity.fit_arrays(x, np.stack([first, second], 1), fold)
    assert len(weights[0]) == 7 and len(weights[1]) == 8
    assert known == pytest.approx(slow_chain(x, np.stack([first, second], 1), fold), abs=1e-3)
    chosen = [[np.array([0, 1]), np.array([], int)]] * 6  # the second link has the first's log-odds only
    weights, known = toxicity.fit_arrays(x, np.stack([first, second], 1), fold, chosen)
    assert not weights[1][:6].any() and weights[1][6] > 0.1
    cut = toxicity.best_cut(known[:, 1], second)
    words = np.arange(6)
    flags = toxicity.Chain(["poor", "toxic"], words, weights, cut).margins(x)[:, -1] >= cut
    assert (flags == second).mean() > 0.8
    dead = toxicity.Chain(["poor", "toxic"], words, [np.zeros(7), weights[1]], cut).margins(x)[:, -1] >= cut
    assert (flags != dead).mean() > 0.2  # the flag hangs on the first link
    assert toxicity.best_cut(np.array([3.0, 1.0, 1.0, -1.0, -5.0]), np.array([1.0, 1.0, 1.0, 0.0, 0.0])) == 0.0


def test_toxicity_on_odd_rows(spark):
    """Repeated and conflicting labels, ties, nulls and clashing columns."""
    draw = random.Random(16)
    texts = [" ".join([draw.choice(["w%d" % k for k in range(200)]) for _ in range(30)] + (["moron"] * 2 if i % 4 == 0 else [])) for i in range(400)]
    rows = spark.createDataFrame([(i, t, "en", "mine", 0.5) for i, t in enumerate(texts)] + [(None, texts[0], None, "mine", 0.5), (7, texts[7], "en", "mine", 0.5), (500, None, None, None, None)], "doc_id long, text string, lang string, toxic string, p_toxic double")
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(400)]
    plain = toxicity.fit(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = spark.createDataFrame(labels + labels[:50] + [(8, 0, 0), (8, None, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int").repartition(7)
    again = toxicity.fit(rows.repartition(5), odd)
    assert plain.words.tolist() == again.words.tolist()
    out = toxicity.score(rows, again).collect()
    assert len(out) == 403 and {r["doc_id"] for r in out if r["toxic"]} == {None, *range(0, 400, 4)}
    kept = toxicity.clean(rows, again)
    assert kept.columns == rows.columns and kept.filter("toxic = 'mine'").count() == 301


# Language


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def slow_word(word, prob, pieces):
    """Log of the sum over all segmentations of the mark and the word, exact."""
    text, longest = langid.MARK + word, max(map(len, pieces))
    sums = [fractions.Fraction(1)] + [fractions.Fraction(0)] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - longest), end):
            k = pieces.get(text[begin:end])
            if k is None and end - begin == 1:
                k = len(pieces)
            if k is not None:
                sums[end] += sums[begin] * fractions.Fraction(float(prob[k]))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_forward_equals_slow_sum():
    """All pieces, long ones too, and words of several hundred characters."""
    names = langid.pieces_of(PIECES)
    pieces = {p: i for i, p in enumerate(names)}
    prob = np.random.default_rng(13).random((len(names) + 1, 2)) ** 4 + 1e-6
    prob /= prob.sum(axis=0)
    model = langid.Model(PIECES, ["a", "b"], prob).ready()
    draw = random.Random(17)
    long_pieces = [p for p in names if 9 <= len(p) <= 16]
    assert len(long_pieces) > 1000
    words = ["the", "heilige", "garçon", "x", "中文", "abcdefghijklmnopqrs", "".join(draw.choice(long_pieces) for _ in range(16)), "".join(draw.choice("abcdef中文ñ\U0001f642") for _ in range(300)), "".join(draw.choice(names) for _ in range(40))]
    assert len(words[-3]) > 140
    got = model.scores(words)
    want = np.array([[slow_word(w, prob[:, k], pieces) for k in range(2)] for w in words])
    assert got == pytest.approx(want, rel=1e-9)
    for i, w in enumerate(words):
        points = np.array([ord(c) for c in langid.MARK + w], np.int64)
        for step in (7, 50):  # through a window
            assert langid.long_score(model.lattice, points, prob, step) == pytest.approx(want[i], rel=1e-9)
    for points, lengths, own in langid.grouped(words):
        counts = langid.expected(model.lattice, points, lengths, prob, np.ones((len(lengths), 2)), len(names) + 1)
        for k in range(2):
            covered = sum(counts[i, k] * len(p) for p, i in pieces.items()) + counts[len(names), k]
            assert covered == pytest.approx(lengths.sum())
    # The count of a piece is how the sum answers to its probability.
    points, lengths, own = next(iter(langid.grouped(["heilige"])))
    counts = langid.expected(model.lattice, points, lengths, prob, np.ones((1, 2)), len(names) + 1)
    for k in np.argsort(-counts[:, 0])[:5]:
        nudged = prob[:, 0].copy()
        nudged[k] *= 1 + 1e-5
        assert counts[k, 0] == pytest.approx((slow_word("heilige", nudged, pieces) - slow_word("heilige", prob[:, 0], pieces)) / 1e-5, rel=1e-2, abs=1e-6)


def test_kept_scores_are_the_same(monkeypatch):
    names = langid.pieces_of(PIECES)
    prob = np.random.default_rng(3).random((len(names) + 1, 3))
    model = langid.Model(PIECES, ["a", "b", "c"], prob / prob.sum(axis=0)).ready()
    monkeypatch.setattr(langid, "KEEP", 30)
    draw = random.Random(4)
    for _ in range(6):
        words = ["".join(draw.choice("abcde") for _ in range(draw.randrange(1, 4))) for _ in range(20)]
        words = sorted(set(words))
        hashes = np.array([int.from_bytes(w.encode().ljust(8), "big") for w in words], np.uint64)
        assert model.of_hashes(hashes, lambda own: [words[i] for i in own]).tolist() == model.scores(words).tolist()
        assert len(model.known) <= 30


def test_language_sample_is_bounded_and_has_all_languages(spark):
    rows = [("text %d" % i, "en") for i in range(4000)] + [("the same text", "de")] * 3000 + [("nur %d" % i, "fr") for i in range(5)]
    table = spark.createDataFrame(rows, "text string, lang string")
    found = collections.Counter(r["lang"] for r in langid.sampled(table, 300).collect())
    assert found["de"] == 1 and found["fr"] == 5 and 60 <= found["en"] <= 150


def test_language_held_out(spark):
    draw = random.Random(14)
    parts = {"en": ["the", "ing", "tion", "wh", "and"], "de": ["sch", "ung", "der", "keit", "über"], "fr": ["eau", "ment", "les", "qué", "è"]}
    texts, langs = [], []
    for i in range(240):
        lang = draw.choice(list(parts))
        texts.append(" ".join("".join(draw.choice(parts[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(3, 40))))
        langs.append(lang)
    texts += [None, "", "123 ... 456", "der"]
    langs += ["en", None, "fr", None]
    rows = docs(spark, texts, langs)
    model = langid.fit(rows.filter("doc_id < 160"), public_tokenizers.path("piece_bpe_32k.model"))
    out = {r["doc_id"]: r for r in langid.predict(rows, model).collect()}
    assert sum(out[i]["lang_pred"] == langs[i] for i in range(160, 240)) >= 78
    assert [out[i]["lang_pred"] for i in range(240, 244)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.predict(rows.filter("false"), model).count() == 0
    nothing = langid.fit(rows.filter("false"), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in langid.predict(rows.limit(3), nothing).collect()} == {"und"}
    odd = spark.createDataFrame([(None, "der"), (None, None), (7, "und " * 30_000 + "x" * 200_000), (7, "the")], "doc_id long, text string")
    found = langid.predict(odd.select("doc_id", "text", F.lit("clash").alias("lang_pred")), model).collect()
    assert sorted(r["lang_pred"] for r in found if r["doc_id"] is None) == ["de", "und"] and len(found) == 4
    assert odd.select((langid.remainder() == 2).alias("h")).filter("h is null").count() == 0
    kept = rows.select("doc_id", langid.remainder().alias("r")).limit(50).collect()
    assert all(r["r"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in kept)


# Pipeline


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(15)
    new = lambda n: " ".join("w%d" % draw.randrange(4000) for _ in range(n))
    item = new(15)
    texts, labels = [], []
    for i in range(400):
        t = new(draw.randrange(12, 60))
        if i % 8 == 1:
            t += " moron"
        labels.append((i, 1, int(i % 8 == 1)))
        texts.append(t)
    texts[2], texts[10] = texts[4], texts[4] + " extra"
    texts[16] += " " + item
    texts[24] += " password=abcdef123"
    texts[400:] = ["", None]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"]: r["text"] for r in rows.collect()})
    everything = set(range(402))
    toxic = {i for i in range(400) if i % 8 == 1}
    assert set(seen[0]) == everything - toxic
    assert set(seen[1]) == set(seen[0]) - {4, 10}
    assert set(seen[2]) == set(seen[1]) - {16}
    assert set(seen[3]) == set(seen[2]) and "[SECRET]" in seen[3][24] and "abcdef123" not in seen[3][24]
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == set(seen[3])


def brute_pipeline(rows, flagged, items):
    """(doc_id, text) rows after the first four stages, given what is toxic:
    one row of each component, no row with a benchmark window, base secrets marked."""
    rows = [r for r in rows if r[1] not in flagged]
    component = {}
    for (d, _, least), r in zip(brute_join([(i, r[1]) for i, r in enumerate(rows)]), rows):
        component.setdefault(least, []).append(r)
    kept = []
    for group in component.values():
        with_words = [r for r in group if (r[1] or "").split()]
        kept += [min(with_words, key=lambda r: (r[0] is None, r[0] or 0, r[1]))] if with_words else group
    windows = [re.findall("[a-z0-9]+", t.lower()) for t in items]
    windows = {tuple(w[i : i + 10]) for w in windows for i in range(len(w) - 9)}
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    kept = [r for r in kept if not any(tuple(words(r[1])[i : i + 10]) in windows for i in range(len(words(r[1]))))]
    out = []
    for d, t in kept:
        for s, _, e in reversed(base_spans(t or "")):
            t = t[:s] + "[SECRET]" + t[e:]
        out.append((d, t))
    return sorted(out, key=str)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline_on_odd_rows_equals_brute_force(spark, tmp_path):
    """Repeated and missing doc_ids, two texts of one doc_id, nulls, and columns
    named like the stages' own; and an empty table."""
    import corpus_pipeline

    draw = random.Random(23)
    new = lambda n: " ".join("w%d" % draw.randrange(3000) for _ in range(n))
    item, secret, twin = new(14), new(20) + " password=abcdef123", new(30)
    rows = [(i, new(draw.randrange(12, 50)) + (" scum moron" if i % 7 == 1 else "")) for i in range(300)]
    rows += [(3, rows[40][1]), (None, new(20)), (None, twin), (None, twin), (900, twin), (900, twin), (901, twin + " more"), (902, item + " x"), (902, secret), (903, secret.upper()), (None, None), (904, None), (905, ""), (905, "")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, key string, spans string, toxic string, print string, label string"
    table = spark.createDataFrame([(d, t, "en", "s", 1, "k", "own", "t", "p", "l") for d, t in rows], columns)
    table.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 1)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs_ = stage(spark, docs_, str(tmp_path))
        assert docs_.columns == table.columns
        docs_.write.parquet(f"{tmp_path}/stage{k}")
        docs_ = spark.read.parquet(f"{tmp_path}/stage{k}")
    found = docs_.collect()
    flagged = {t for i, t in rows[:300] if i % 7 == 1}
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == brute_pipeline(rows, flagged, [item])
    assert {(r["key"], r["spans"], r["toxic"], r["print"], r["label"]) for r in found} == {("k", "own", "t", "p", "l")}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in packed.select("doc_id").collect()) == sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in found)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
