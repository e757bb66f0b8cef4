import itertools
import re

import pytest
from pyspark.sql import functions as F

from lexigraph.functions.patterns import Pattern

ACCEPTED = ["a", "a|b", "(a|b)*", "ab+c?", "a.*b", "[a-c]+", "[^b]*", "(ab|ba)?", "a(b|)c", "(a*)*", r"a\?", "[-ab]+", "[a-c]?b*"]
REJECTED = ["", "(", ")", "[abc", "[]", "[z-a]", "*a", "a**", "\\", r"\d", "^a$", "a{2}", "a" * 129]
WORDS = ["".join(w) for n in range(5) for w in itertools.product("abc", repeat=n)] + ["a?"]


@pytest.mark.parametrize("text", ACCEPTED)
def test_automaton_equals_full_match(text):
    pattern = Pattern(text)
    assert [pattern.fullmatch(w) for w in WORDS] == [bool(re.fullmatch(text, w)) for w in WORDS]


def test_columns_equal_full_match(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string")
    out = rows.select("w", *(Pattern(t).matches(F.col("w")).alias(str(i)) for i, t in enumerate(ACCEPTED))).collect()
    for row in out:
        assert [row[str(i)] for i in range(len(ACCEPTED))] == [bool(re.fullmatch(t, row["w"])) for t in ACCEPTED], row["w"]


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    with pytest.raises(ValueError):
        Pattern(text)


def test_nested_repetition_is_linear():
    assert Pattern("(a+)+b").fullmatch("a" * 10_000) is False


def test_long_words_use_the_automaton(spark):
    rows = spark.createDataFrame([("ab" * 5000 + "c",), ("ab" * 5000,)], "w string")
    assert [r[0] for r in rows.select(Pattern("(a|b)*c").matches(F.col("w"))).collect()] == [True, False]


def test_java_syntax_cannot_leak(spark):
    rows = spark.createDataFrame([("a",), ("&",), ("[",), ("]",), ("\n",), ("🙂",)], "w string")
    found = lambda t: [r[0] for r in rows.filter(Pattern(t).matches(F.col("w"))).collect()]
    assert found("[a&&b]") == ["a", "&"]
    assert found("[[]") == ["["]
    assert found("]") == ["]"]
    assert len(found(".")) == 6


def test_first_characters():
    assert Pattern("sea|ocean").first_characters() == {"s", "o"}
    assert Pattern("s?ocean").first_characters() == {"s", "o"}
    assert Pattern("(sea|)ocean?").first_characters() == {"s", "o"}
    assert Pattern("()").first_characters() == set()
    assert Pattern("[^s].*").first_characters() is None
    assert Pattern(".*").first_characters() is None
