"""The regular expressions of vocabulary search.

Alternation, groups, classes with ranges, ``.``, and one of ``* + ?`` behind an
atom; matches are of whole words. A pattern is parsed here and never given to
Java as it stands: it is written anew, each literal as a code point, so that
nothing of Java's larger language can be reached. Patterns that repeat a
repetition, which a backtracking matcher may take exponential time for, are run
as a set-of-states automaton in an Arrow function over the distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 128
WIDEST_RANGE = 512
TOP = 0x10FFFF
#: First characters for which ranges replace a scan of the vocabulary.
RANGES = 8
#: Longer words go to the automaton, whatever the pattern.
SAFE_LENGTH = 500


@dataclass(frozen=True)
class Node:
    """kind: chars (members, negated), any, seq, alt or rep (mark * + ?)."""

    kind: str
    parts: tuple["Node", ...] = ()
    members: frozenset[str] = frozenset()
    negated: bool = False
    mark: str = ""


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        self.at += 1
        return c

    def whole(self) -> Node:
        found = self.choice()
        if self.at < len(self.text):
            raise ValueError(f"Unexpected character {self.peek()!r} in the expression.")
        return found

    def choice(self) -> Node:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else Node("alt", tuple(options))

    def sequence(self) -> Node:
        parts: list[Node] = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return Node("seq", tuple(parts))

    def repeated(self) -> Node:
        atom = self.atom()
        if self.peek() and self.peek() in "*+?":
            atom = Node("rep", (atom,), mark=self.take())
            if self.peek() and self.peek() in "*+?":
                raise ValueError("A repetition cannot be repeated without a group.")
        return atom

    def escaped(self) -> str:
        c = self.take()
        if not c:
            raise ValueError("The expression ends in a backslash.")
        if c.isalnum():
            raise ValueError(f"Unknown escape \\{c}.")
        return c

    def atom(self) -> Node:
        c = self.take()
        if c == "(":
            inner = self.choice()
            if self.take() != ")":
                raise ValueError("A group is not closed.")
            return inner
        if c == "[":
            return self.group()
        if c == ".":
            return Node("any")
        if c == "\\":
            return Node("chars", members=frozenset(self.escaped()))
        if c in "*+?^${}":
            raise ValueError(f"Unexpected {c!r} in the expression.")
        return Node("chars", members=frozenset(c))

    def group(self) -> Node:
        negated = self.peek() == "^"
        if negated:
            self.take()
        members: set[str] = set()
        while True:
            c = self.take()
            if not c:
                raise ValueError("A class is not closed.")
            if c == "]":
                break
            low = self.escaped() if c == "\\" else c
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("", "]"):
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else c
                if not 0 <= ord(high) - ord(low) <= WIDEST_RANGE:
                    raise ValueError("A range is reversed or too wide.")
                members.update(map(chr, range(ord(low), ord(high) + 1)))
            else:
                members.add(low)
        if not members:
            raise ValueError("A class is empty.")
        return Node("chars", members=frozenset(members), negated=negated)


def empty_ok(node: Node) -> bool:
    if node.kind == "seq":
        return all(map(empty_ok, node.parts))
    if node.kind == "alt":
        return any(map(empty_ok, node.parts))
    return node.kind == "rep" and (node.mark != "+" or empty_ok(node.parts[0]))


def first_of(node: Node) -> set[str] | None:
    """Characters a match can begin with; None: not a finite set."""
    if node.kind == "any" or node.kind == "chars" and node.negated:
        return None
    if node.kind == "chars":
        return set(node.members)
    out: set[str] = set()
    for part in node.parts:
        own = first_of(part)
        if own is None:
            return None
        out |= own
        if node.kind == "seq" and not empty_ok(part):
            break
    return out


def _spelled(c: str) -> str:
    return f"\\x{{{ord(c):x}}}"


def _java(node: Node) -> str:
    if node.kind == "any":
        return "."
    if node.kind == "chars":
        codes = sorted(map(ord, node.members))
        runs: list[list[int]] = []
        for c in codes:
            if runs and c == runs[-1][1] + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        body = "".join(_spelled(chr(a)) + (f"-{_spelled(chr(b))}" if b > a else "") for a, b in runs)
        return f"[{'^' * node.negated}{body}]"
    if node.kind == "alt":
        return "(?:" + "|".join(map(_java, node.parts)) + ")"
    if node.kind == "seq":
        return "".join(map(_java, node.parts))
    return f"(?:{_java(node.parts[0])}){node.mark}"


def _nested(node: Node, inside: bool = False) -> bool:
    """Whether a repetition (of more than one) stands inside another."""
    many = node.kind == "rep" and node.mark != "?"
    return many and inside or any(_nested(p, inside or many) for p in node.parts)


class Automaton:
    """States as positions of the pattern; a word is read once, keeping the set
    of positions that may have just matched. Steps are remembered."""

    REMEMBERED = 16_384

    def __init__(self, node: Node):
        self.leaves: list[Node] = []
        self.after: list[set[int]] = []
        first, last, self.accepts_empty = self._walk(node)
        self.first, self.last = frozenset(first), frozenset(last)
        self.steps: dict[tuple[frozenset[int], str], frozenset[int]] = {}

    def _walk(self, node: Node) -> tuple[set[int], set[int], bool]:
        if node.kind in ("any", "chars"):
            self.leaves.append(node)
            self.after.append(set())
            at = {len(self.leaves) - 1}
            return at, set(at), False
        if node.kind == "alt":
            parts = [self._walk(p) for p in node.parts]
            return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)
        if node.kind == "rep":
            first, last, empty = self._walk(node.parts[0])
            if node.mark != "?":
                for at in last:
                    self.after[at] |= first
            return first, last, empty or node.mark != "+"
        first, last, empty = set(), set(), True
        for part in node.parts:
            f, end, e = self._walk(part)
            for at in last:
                self.after[at] |= f
            first |= f if empty else set()
            last = end | (last if e else set())
            empty = empty and e
        return first, last, empty

    def _fits(self, at: int, c: str) -> bool:
        leaf = self.leaves[at]
        return leaf.kind == "any" or (c in leaf.members) != leaf.negated

    def fullmatch(self, word: str) -> bool:
        if not word:
            return self.accepts_empty
        may, matched = self.first, frozenset()
        for c in word:
            key = (may, c)
            step = self.steps.get(key)
            if step is None:
                step = frozenset(at for at in may if self._fits(at, c))
                if len(self.steps) < self.REMEMBERED:
                    self.steps[key] = step
            if not step:
                return False
            matched = step
            may = frozenset().union(*(self.after[at] for at in step))
        return bool(matched & self.last)


class Pattern:
    """A parsed expression; ``ValueError`` for what the language leaves out."""

    def __init__(self, text: str):
        if not 1 <= len(text) <= LONGEST:
            raise ValueError("Enter an expression of 1 to 128 characters.")
        self.text = text
        self.tree = _Parser(text).whole()
        self.java = f"\\A(?s:{_java(self.tree)})\\z"
        self.automaton = Automaton(self.tree)
        self.nested = _nested(self.tree)

    def fullmatch(self, word: str) -> bool:
        return self.automaton.fullmatch(word)

    def first_characters(self) -> set[str] | None:
        return first_of(self.tree)

    def prefilter(self, word: Column) -> Column | None:
        """Ranges of the word order that hold all matches, for Parquet's
        statistics; None where a scan of the vocabulary is needed."""
        first = self.first_characters()
        if first is None or len(first) > RANGES:
            return None
        parts = [(word >= c) & (word < chr(ord(c) + 1)) if ord(c) < TOP else word >= c for c in sorted(first) if not 0xD7FF <= ord(c) <= 0xDFFF]
        if empty_ok(self.tree):
            parts.append(word == "")
        out: Column = F.lit(False)
        for part in parts:
            out = out | part
        return out

    def matches(self, word: Column, safe: bool = False) -> Column:
        """Whether the whole word matches. ``safe``: no word is longer than
        SAFE_LENGTH, so that the automaton is needed for nested patterns only."""
        walk = F.pandas_udf(_walker(self.tree), "boolean")
        return walk(word) if self.nested else word.rlike(self.java) if safe else F.when(F.length(word) <= SAFE_LENGTH, word.rlike(self.java)).otherwise(walk(F.when(F.length(word) > SAFE_LENGTH, word)))


def _walker(tree: Node):
    def walk(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Automaton(tree)
        for part in words:
            yield part.map(lambda w: None if w is None else machine.fullmatch(w))

    walk.__annotations__ = {"words": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return walk
