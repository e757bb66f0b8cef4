"""Text functions as Spark columns: cleaning, folding, tokens, digests.

A word is a run of letters and letter-like numbers (categories L*, Nl, No),
joined by apostrophes; digits and marks separate words. Everything runs inside
the JVM but for texts with characters beyond Latin-1, whose normal form and
full case folding no built-in function gives; only those go through Arrow.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTER = r"\p{L}\p{Nl}\p{No}"
#: A word in folded text, in which apostrophes are straight.
WORD_PATTERN = f"[{LETTER}]+(?:'[{LETTER}]+)*"
#: Lines that wrap a book's text, fixed by the source of the books. Java needs
#: the flag d, or ^ also matches behind other line separators than LF.
START_MARK = r"(?imd)^\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG.*?\*\*\*"
END_MARK = r"(?imd)^\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG.*?\*\*\*"
#: What str.strip and str.split count as white space.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE_CHARACTERS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Texts made of these need no normal form, and fold by lower() and two rules.
EASY = r"^[\x00-\x{FF}\x{2010}-\x{2027}]*$"
EXCERPT = 650


def normalize_newlines(text: Column) -> Column:
    """LF for CR CR LF, CR LF and CR, replaced in this order."""
    for end in ("\r\r\n", "\r\n", "\r"):
        text = F.replace(text, F.lit(end), F.lit("\n"))
    return text


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_CHARACTERS))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


def is_easy(text: Column) -> Column:
    return text.rlike(EASY)


def compose(text: Column) -> Column:
    """Normal form C; easy texts are in it already and aren't sent to Python."""
    return F.coalesce(_composed(F.when(~is_easy(text), text)), text)


def casefold(text: Column) -> Column:
    """Full case folding of the normal form C, apostrophes straight."""
    easy = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    folded = F.coalesce(_folded(F.when(~is_easy(text), text)), easy)
    return F.replace(folded, F.lit("’"), F.lit("'"))


def _without_wrapper(text: Column) -> Column:
    """Cut through the first start mark's end, then at the first end mark."""
    begun = F.when(text.rlike(START_MARK), F.element_at(F.split(text, START_MARK, 2), 2)).otherwise(text)
    return F.when(begun.rlike(END_MARK), F.element_at(F.split(begun, END_MARK, 2), 1)).otherwise(begun)


def clean_text(text: Column) -> Column:
    """The text of a book without its wrapper, in normal form C and stripped.
    Texts without the stars of both marks are spared the search for them."""
    lines = normalize_newlines(text)
    return strip(compose(F.when(lines.contains("***"), _without_wrapper(lines)).otherwise(lines)))


def tokens(text: Column) -> Column:
    """array<string> of the text's words, in order."""
    return F.regexp_extract_all(casefold(text), F.lit(WORD_PATTERN), F.lit(0))


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def excerpt(content: Column, size: int = EXCERPT) -> Column:
    """The first characters with white space collapsed. A beginning of the text
    is enough where that gives more than is asked for."""
    collapsed = lambda text: strip(F.regexp_replace(text, f"[{WHITE}]+", " "))
    head = collapsed(F.substring(content, 1, 4 * size))
    return F.substring(F.when(F.length(head) > size, head).otherwise(collapsed(content)), 1, size)


def fold_query(text: str) -> str:
    """The driver's side of ``casefold``."""
    return unicodedata.normalize("NFC", text).casefold().replace("’", "'")


def query_tokens(text: str) -> list[str]:
    """The driver's side of ``tokens``."""
    import regex

    return regex.findall(WORD_PATTERN, fold_query(text))


def is_html(text: Column) -> Column:
    """Whether a download is a web page, not a text."""
    head = F.lower(F.substring(F.regexp_replace(text, f"^[{WHITE}]+", ""), 1, 16))
    return head.startswith("<!doctype html") | head.startswith("<html")


def too_large(text: Column, limit: int = 20_000_000) -> Column:
    return F.octet_length(text) > limit
