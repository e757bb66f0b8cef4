import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.functions import text as T

STAR = "*** START OF THE PROJECT GUTENBERG EBOOK X ***"
END = "*** END OF THIS PROJECT GUTENBERG EBOOK X ***"


def column(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(rows.select("i", f(F.col("t"))).collect())]


@pytest.mark.parametrize("said", ["THE", "THIS"])
def test_only_what_is_between_the_marks_counts(spark, said):
    texts = [
        f"About this file.\n*** START OF {said} PROJECT GUTENBERG EBOOK 7 ***\n\n  Grüße, O’Neill’s “Straße” 1850!  \n\n*** END OF {said} PROJECT GUTENBERG EBOOK 7 ***\nTerms.",
        f"*** end of {said} project gutenberg ebook ***\nnothing before",
        "no marks at all",
    ]
    assert column(spark, texts, T.clean_text) == ["Grüße, O’Neill’s “Straße” 1850!", "", texts[2]]
    assert column(spark, texts[:1], lambda c: T.tokens(T.clean_text(c))) == [["grüsse", "o'neill's", "strasse"]]


@pytest.mark.parametrize("end", ["\r\n", "\r\r\n", "\r"])
def test_line_ends_give_the_same_text(spark, end):
    plain = "sea ocean\n\nwhale adventure\n"
    a, b = column(spark, [plain, plain.replace("\n", end)], T.clean_text)
    assert a == b == plain.strip()


def test_line_ends_are_replaced_in_order(spark):
    """CR CR LF first, then CR LF, then CR, each all through the text."""
    texts = ["a\r\r\r\nb", "a\r\r\nb", "\n\r\n\r", "a\r\r\r\r\nb"]
    expected = []
    for t in texts:
        for end in ("\r\r\n", "\r\n", "\r"):
            t = t.replace(end, "\n")
        expected.append(t)
    assert column(spark, texts, T.normalize_newlines) == expected == ["a\nb", "a\nb", "\n\n\n", "a\n\nb"]


def test_marks_only_at_line_starts_and_in_order(spark):
    texts = [f"x {STAR} y", f"{END}\nbefore\n{STAR}\nafter", f"a {STAR}\nb"]
    assert column(spark, texts, T.clean_text) == [texts[0], "after", texts[2]]


words = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé ßÉ'’1_²½-\ńﬁΣςİıµ 漢Ⅷ٣"), max_size=12), min_size=1, max_size=20))
def test_tokens_equal_the_definition(spark, texts):
    expected = [words.findall(unicodedata.normalize("NFC", t).casefold().replace("’", "'")) for t in texts]
    assert column(spark, texts, T.tokens) == expected
    assert [T.query_tokens(t) for t in texts] == expected


def test_excerpt_counts_characters(spark):
    assert column(spark, ["  a \n\t b c " + "é" * 700], T.excerpt) == ["a b c " + "é" * 644]


def test_excerpt_of_much_white_space(spark):
    texts = ["a" + " " * 3000 + "b " * 900, "x " * 2000, " \n" * 5000 + "end", "w" * 649 + " " * 2600 + "z"]
    assert column(spark, texts, T.excerpt) == [" ".join(t.split())[:650] for t in texts]


def test_strip_equals_pythons(spark):
    texts = [c + " a" + c + "b" + c for c in T.WHITE_CHARACTERS] + ["\u200b a", "", "  "]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]


def test_html_and_size(spark):
    texts = [" \n<!DOCTYPE html><p>", "<HTML>", "text <html>", ""]
    assert column(spark, texts, T.is_html) == [True, True, False, False]
    assert column(spark, ["abc", "ab", "é"], lambda c: T.too_large(c, 2)) == [True, False, False]
