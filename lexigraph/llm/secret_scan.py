"""Secret spans by patterns and a battery of randomness tests, in Spark SQL.

Base kinds are regular expressions (``assign``, ``access``, ``hex``). The
method adds ``random``: runs of 20 or more encoding characters, outside base
spans, whose characters look drawn at random from the alphabet of
the encoding they fit (hex, base32, base36, base62, base64). Three tests measure
that: chi-squared uniformity over the alphabet (its tail by a gamma law with the
exact mean and variance of small samples), Wald-Wolfowitz runs about the
alphabet's middle, and lag-one serial correlation; the run's score is the
smallest of the three p-values, corrected for three tries.

What is reported is controlled against ordinary text. The null hypothesis is
that a run is made of the corpus's own words, of all of them: each text's words,
in order, are cut into stretches of some 150 characters; a stretch is put in
small letters, capitals or initial capitals, glued without a sign, by one of
"_-/" or by a number (by a hash of it), and cut into runs of lengths near the
lower ends of the length classes, where the tests are weakest. A run's p-value is the share of its
class's ordinary runs whose score is at least as high, and within each class
(length, as the tests' power grows with it, and the letters' case) the
Benjamini-Hochberg rule at level ``q`` picks the runs that are spans: of those
reported about a share q at most is ordinary text. Where a class has too few
ordinary runs to tell, it reports none.

Positions come from splitting at matches: lengths of the pieces between them
and of the matches add up to offsets in code points, end exclusive. What the
rule needs from the corpus is a histogram of scores by length class, at most
a few thousand counts; the text is never shuffled.

Null text is empty (no spans); repeated rows each get their row; an empty table
gives no rows; extra columns are kept, but those named like a result give way to it;
``redact`` keeps all columns.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract of the base kinds: pattern, the group whose length
#: counts, and the least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The kinds' own scanners: a maximal run that is too short can't hold a longer
#: match, so access and hex put the least length in the pattern.
SCAN = {"assign": BASE[0][1], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Encodings from the narrowest: name, pattern of a whole run, alphabet.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)
#: Whether an encoding has small letters only, capitals only, or both.
CASES = tuple(2 if "A" in letters and "a" in letters else int("A" in letters) for _, _, letters in ENCODINGS)
#: Share of ordinary text among reported runs, at most.
Q = 0.01
#: Lower ends of the length classes.
LENGTHS = (20, 32, 64)
CLASSES = 3 * len(LENGTHS)
#: Bins of scores: quarter powers of two, up to this one.
BINS = 400
#: Bins up to which ordinary runs' scores are right at first, by class.
CUTS = (16, 48, 160, 16, 48, 160, 28, 80, BINS - 1)
#: Characters of a stretch of words, at least; up to so many left over go to the last one; glue by draw (null: a number).
STRETCH, REST = 150, 40
#: An ordinary run is up to so much longer than its class asks for.
LONGER = 12
SIGNS = "_-/"
GLUE = ("", "", "_", "-", "/", None)
#: Abramowitz and Stegun 7.1.26, the complementary error function (fixed values).
ERFC_P = 0.3275911
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def spans_of(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """array<struct<start, kind, end>> of the matches whose group is long
    enough. A text without a match is passed over once."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else whole
    sizes = F.zip_with(whole, part, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), sizes, lambda gap, s: F.struct(gap.alias("gap"), s["m"].alias("m"), s["g"].alias("g")))
    empty = F.expr(f"struct(0 as at, {NO_SPANS} as spans)")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["m"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["g"] >= least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(steps, empty, step, lambda acc: acc["spans"])).otherwise(F.expr(NO_SPANS))


def erfc(x: Column) -> Column:
    t = 1 / (1 + ERFC_P * x)
    total: Column = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        total = total * t + c
    return total * t * F.exp(-x * x)


def two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def gamma_tail(ratio: Column, freedom: Column) -> Column:
    """Upper tail of a chi-squared law over its mean, by the cube root (Wilson
    and Hilferty). With ``freedom`` (k - 1) n / (n - 1) it has the exact mean and
    variance of the statistic of n draws from k letters."""
    z = (F.cbrt(ratio) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    half = erfc(F.abs(z) / math.sqrt(2)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def chi_tail(squares: Column, n: Column, k: Column) -> Column:
    """For the sum of squared counts of n letters out of k."""
    return gamma_tail((squares * k / n - n) / (k - 1), (k - 1) * n / (n - 1))


def corrected(p: Column) -> Column:
    """The smallest p-value of three tries."""
    return 1 - F.pow(1 - p, F.lit(3.0))


def encoding_of(token: Column) -> Column:
    """The number of the narrowest encoding that fits, from 1, or null."""
    which: Column = F.lit(None).cast("int")
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        which = F.when(token.rlike(pattern), F.lit(i + 1)).otherwise(which)
    return which


def battery(tokens: Column) -> Column:
    """For array<struct<start, end, token>> the array<struct<start, end,
    encoding, case, n, p>>: n is the length without padding, p the score (0 to 1);
    a run that fits no encoding has p 0."""

    def fit(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), encoding_of(x["token"]).alias("which"), F.regexp_replace(x["token"], "=+$", "").alias("bare"))

    def named(x: Column) -> Column:
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), x["which"])
        name, letters = of([n for n, _, _ in ENCODINGS]), F.coalesce(of([a for _, _, a in ENCODINGS]), F.lit(""))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), name.alias("encoding"), F.coalesce(of(CASES), F.lit(2)).alias("case"), letters.alias("alphabet"), x["bare"].alias("bare"))

    def values(x: Column) -> Column:
        letters = F.filter(F.split(x["bare"], ""), lambda c: c != "")
        v = F.transform(letters, lambda c: F.instr(x["alphabet"], c).cast("double") - 1)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["encoding"].alias("encoding"), x["case"].alias("case"), F.length(x["bare"]).cast("double").alias("n"), F.length(x["alphabet"]).cast("double").alias("k"), v.alias("v"))

    def sums(x: Column) -> Column:
        zero = F.lit(0.0)
        # In the sorted values each adds 2c + 1 to the sum of squared counts, c being how many of its kind came before.
        squares = F.aggregate(
            F.array_sort(x["v"]),
            F.struct(F.lit(-9.0).alias("last"), zero.alias("c"), zero.alias("total")),
            lambda a, y: F.struct(y.alias("last"), F.when(y == a["last"], a["c"] + 1).otherwise(1.0).alias("c"), (a["total"] + F.when(y == a["last"], 2 * a["c"] + 1).otherwise(1.0)).alias("total")),
            lambda a: a["total"],
        )
        half = x["k"] / 2
        fold = F.aggregate(
            x["v"],
            F.struct(F.lit(-9.0).alias("last"), *(zero.alias(c) for c in ("ones", "runs", "s", "ss", "lag"))),
            lambda a, y: F.struct(
                y.alias("last"),
                (a["ones"] + F.when(y >= half, 1.0).otherwise(0.0)).alias("ones"),
                (a["runs"] + F.when((a["last"] < -8) | ((a["last"] >= half) != (y >= half)), 1.0).otherwise(0.0)).alias("runs"),
                (a["s"] + y).alias("s"),
                (a["ss"] + y * y).alias("ss"),
                (a["lag"] + F.when(a["last"] < -8, 0.0).otherwise(a["last"] * y)).alias("lag"),
            ),
        )
        ring = F.element_at(x["v"], -1) * F.element_at(x["v"], 1)
        return F.struct(*(x[c].alias(c) for c in ("start", "end", "encoding", "case", "n", "k")), squares.alias("squares"), fold.alias("f"), ring.alias("ring"))

    def judge(x: Column) -> Column:
        n, k, f = x["n"], x["k"], x["f"]
        p_chi = chi_tail(x["squares"], n, k)
        both = 2 * f["ones"] * (n - f["ones"])
        var = both * (both - n) / (n * n * (n - 1))
        p_runs = F.when(var > 0, two_sided((f["runs"] - both / n - 1) / F.sqrt(var))).otherwise(0.0)
        spread = n * f["ss"] - f["s"] * f["s"]
        r = (n * (f["lag"] + x["ring"]) - f["s"] * f["s"]) / spread
        p_serial = F.when(spread > 0, two_sided((r + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n)).otherwise(0.0)
        p = corrected(F.least(p_chi, p_runs, p_serial))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["encoding"].alias("encoding"), x["case"].alias("case"), n.alias("n"), F.when(x["encoding"].isNotNull(), p).otherwise(0.0).alias("p"))

    for step in (fit, named, values, sums, judge):
        tokens = F.transform(tokens, step)
    return tokens


def class_of(x: Column) -> Column:
    """The run's class, by the case of its encoding and its length."""
    out: Column = F.lit(0)
    for i, low in enumerate(LENGTHS):
        out = F.when(x["n"] >= low, F.lit(i)).otherwise(out)
    return x["case"] * len(LENGTHS) + out


def p_bin(p: Column) -> Column:
    return F.when(p <= 0, F.lit(BINS)).otherwise(F.least(F.lit(BINS), F.floor(-4 * F.log2(p)).cast("int")))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*(spans_of(text, SCAN[kind], group, least, i) for i, (kind, _, group, least) in enumerate(BASE))))


def tested_runs(text: Column, base: Column) -> Column:
    """array<struct<start, end, encoding, n, p>> of the text's runs outside ``base``."""
    free = F.filter(spans_of(text, CANDIDATE, 0, 20, 3), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return battery(F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.substring(text, c["start"] + 1, c["end"] - c["start"]).alias("token"))))


def stretches(text: Column) -> Column:
    """The text's words, a space between two, in consecutive stretches. Words that could be runs themselves are left out."""
    gap, long = "[^A-Za-z0-9]+", f"[A-Za-z0-9]{{{LENGTHS[0]},}}+"
    words = F.regexp_replace(F.concat(F.lit(" "), text), f"{gap}(?:{long}(?:{gap}|\\z))*", " ")
    return F.regexp_extract_all(F.trim(words), F.lit(f".{{{STRETCH}}}[^ ]*+(?:.{{0,{REST}}}\\z)?|.+"), F.lit(0))


def ordinary_runs(docs: DataFrame) -> DataFrame:
    """token: runs made of the words of all texts. Each stretch is glued and
    then cut, a run for each length class and one of what is left, so every word
    is in a run but those of stretches too short for one."""
    stretch, number = F.trim("stretch"), F.xxhash64("stretch", F.lit(100))
    pick = lambda seed, values: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("stretch", F.lit(seed)), F.lit(len(values))).cast("int") + 1)
    case = pick(130, (0, 1, 2))
    cased = F.when(case == 0, F.lower(stretch)).when(case == 1, F.upper(stretch)).otherwise(F.initcap(stretch))
    glue = F.coalesce(pick(120, GLUE), F.pmod(F.shiftright(number, 40), F.lit(2100)).cast("string"))
    cuts: list[Column] = [F.lit(0)]
    for i, low in enumerate(LENGTHS):
        cuts.append(cuts[-1] + low + F.pmod(F.shiftright(number, 10 * i), F.lit(LONGER)).cast("int"))
    rows = docs.select(F.explode(stretches(F.coalesce(F.col("text"), F.lit("")))).alias("stretch"))
    rows = rows.select(F.replace(cased, F.lit(" "), glue).alias("glued"), *(cut.alias(f"cut{i}") for i, cut in enumerate(cuts)))
    left = lambda i: F.length("glued") - F.col(f"cut{i}")

    def piece(i: int) -> Column:
        size = left(i) if i == len(LENGTHS) else F.when(left(i + 1) >= LENGTHS[0], F.col(f"cut{i + 1}") - F.col(f"cut{i}")).otherwise(left(i))
        return F.when(left(i) >= LENGTHS[0], F.substring(F.col("glued"), F.col(f"cut{i}") + 1, size))

    return rows.select(F.explode(F.array(*map(piece, range(len(LENGTHS) + 1)))).alias("token")).filter("token is not null")


def ordinary_counts(docs: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """class, bin and ordinary, the number of ordinary runs, for the classes of
    ``cuts``. The bins are right up to the class's cut; other runs are in the last.

    Only the best scores decide, so a run gets the whole battery if the
    chi-squared tail allows one up to the cut even if its capitals among small
    letters all differ."""
    of = lambda values, c: F.element_at(F.array(*map(F.lit, values)), F.col(c))
    rows = ordinary_runs(docs).select("token", F.length("token").cast("double").alias("n"), encoding_of(F.col("token")).alias("which"))
    rows = rows.select("token", "n", of([float(len(a)) for _, _, a in ENCODINGS], "which").alias("k"), class_of({"n": F.col("n"), "case": F.coalesce(of(CASES, "which"), F.lit(2))}).alias("class"))
    rows = rows.filter(F.col("class").isin(*cuts))
    main = F.when(F.col("token") == F.upper("token"), F.lower("token")).otherwise(F.col("token"))
    rows = rows.select("token", "n", "k", "class", main.alias("main"))
    held = [F.col("n") - F.length(F.replace("main", F.lit(letter), F.lit(""))) for letter in LOWER + DIGITS + SIGNS]
    # A letter that is there c times adds c * c, and each other character 1 at least.
    squares = sum((F.pow(c - 0.5, F.lit(2.0)) for c in held), F.col("n") - len(held) / 4)
    # Some bins more, as the tail is an approximation; p is 0 below 2 ** -53.
    worst = [1 - (1 - max(2 ** (-(cuts.get(i, 0) + 4) / 4), 2.0**-56)) ** (1 / 3) or 2.0**-57 for i in range(CLASSES)]
    z = F.element_at(F.array(*(F.lit(-NormalDist().inv_cdf(p)) for p in worst)), F.col("class") + 1)
    rows = rows.select("token", "n", "k", "class", squares.alias("squares"), z.alias("z"))
    spread = 2 * (F.col("n") - 1) / (9 * (F.col("k") - 1) * F.col("n"))
    root = 1 - spread + F.col("z") * F.sqrt(spread)
    most = F.col("n") / F.col("k") * (F.col("n") + (F.col("k") - 1) * root * root * root)
    whole = p_bin(battery(F.array(F.struct(F.lit(0).alias("start"), F.length("token").alias("end"), F.col("token").alias("token"))))[0]["p"])
    rows = rows.select("class", F.when(F.col("squares") <= most, whole).otherwise(BINS).alias("bin"))
    return rows.groupBy("class", "bin").agg(F.count("*").alias("ordinary"))


def span_levels(docs: DataFrame, q: float, cuts: tuple[int, ...] = CUTS) -> list[int]:
    """For each class the last bin of scores whose runs are spans, -1 if none is:
    Benjamini-Hochberg over the corpus's histograms of runs and of ordinary runs
    (classes times bins). A class without runs needs no ordinary ones; where a
    cut comes too early to hold a share ``q`` of them, all bins are made right."""
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = docs.filter(text.rlike(CANDIDATE)).select(F.explode(tested_runs(text, base_spans(text))).alias("x"))
    runs = runs.groupBy(class_of(F.col("x")).alias("class"), p_bin(F.col("x.p")).alias("bin")).agg(F.count("*").alias("runs"))
    own = {(r["class"], r["bin"]): r["runs"] for r in runs.collect()}
    levels = [-1] * CLASSES
    open_ = {i: cuts[i] for i, _ in own}
    while open_:
        ordinary = {(r["class"], r["bin"]): r["ordinary"] for r in ordinary_counts(docs, open_).collect()}
        early = {}
        for i, cut in open_.items():
            count = lambda held, last: sum(x for (c, b), x in held.items() if c == i and b <= last)  # noqa: B023, E731
            m, every = count(own, BINS), count(ordinary, BINS)
            if cut < BINS - 1 and count(ordinary, cut) + 1 <= q * (every + 1):
                early[i] = BINS - 1
                continue
            passed = [b for c, b in own if c == i and b <= cut and (count(ordinary, b) + 1) * m <= q * count(own, b) * (every + 1)]
            levels[i] = max(passed, default=-1)
        open_ = early
    return levels


def located(docs: DataFrame, q: float) -> DataFrame:
    """row (all columns of ``docs``), base_spans and spans."""
    levels, text = span_levels(docs, q), F.coalesce(F.col("row.text"), F.lit(""))
    out = docs.select(F.struct(*docs.columns).alias("row")).withColumn("base_spans", base_spans(text))
    runs = F.filter(tested_runs(text, F.col("base_spans")), lambda x: p_bin(x["p"]) <= F.element_at(F.array(*map(F.lit, levels)), class_of(x) + 1))
    added = F.transform(runs, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    added = F.when(text.rlike(CANDIDATE), added).otherwise(F.expr(NO_SPANS))
    return out.withColumn("spans", F.array_sort(F.concat("base_spans", added)))


def find_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """All columns of ``docs``, base_spans and spans: array<struct<start, kind,
    end>> by start, then kind (an index into KINDS)."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("base_spans", "spans")]
    return located(docs, q).select(*kept, "base_spans", "spans")


def told(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, q: float = Q) -> DataFrame:
    """The counts and digest of each document's spans."""
    found = find_secrets(docs.select("doc_id", "text"), q)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{kind[0]}") for i, kind in enumerate(BASE)), F.sha2(told("base_spans"), 256).alias("base_sha256"), told("spans").alias("spans"))


def redact(docs: DataFrame, q: float = Q, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of spans replaced by ``mark``; n_chars follows."""
    found, old = located(docs, q), F.col("row.text")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(old, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    some = F.size("spans") > 0
    text = F.when(some, F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(old, acc["at"] + 1, F.length(old))))).otherwise(old)
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(some, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select("row", "spans", text.alias("new")).select(*(x.alias(c) for c, x in out.items()))
