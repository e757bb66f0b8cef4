"""Token ids of whole texts by the ``tokenizers`` library.

Text is cut into units: before each run of ASCII white space that follows
another character and, inside a plain segment (one space or line feed, then
ASCII or Latin-1 letters, digits and signs without an apostrophe), also where
letters, digits and signs meet. Both supported pre-tokenizers (byte-level with
the leading-space rule, and word-end BPE that drops white space) give the same
ids for the units as for the whole text, so the library encodes each distinct
unit once and its ids are gathered for every occurrence. A text that holds
white space outside ASCII or a special token's string (in any case of letters),
where the cuts aren't safe, is encoded whole. The library's own settings hold: a
special token's string in a text gives that token's id.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import hash_spans, spread, text_buffer

#: White space that isn't ASCII, and U+001C-U+001F, which some patterns count.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -     　﻿]")
#: Byte kinds: 0 white space, 1 letter, 2 digit, 3 sign, 4 first byte of a
#: Latin-1 letter (or of its two signs), 5 apostrophe, 6 all else.
KIND = np.full(256, 3, np.int8)
KIND[128:] = 6
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[0xC3] = 4
KIND[39] = 5
KIND[:9] = KIND[14:32] = KIND[127] = 6
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = KIND == 0
#: Units whose ids a worker keeps.
KEEP = 400_000
_loaded: dict[str, "Encoder"] = {}


def byte_letters() -> str:
    """The 256 characters that stand for bytes in byte-level vocabularies:
    printable Latin-1 for itself, the others from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return "".join(out)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.I)
        # First signs of special tokens; one that begins with a letter makes all texts suspect.
        self.signs = tuple({b"" if any(c.isalpha() for c in t[:2]) else t[:2].encode() for t in special})
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = self._kind(said)
        self.letters = byte_letters()
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_size = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.uint32)

    @staticmethod
    def _kind(said: dict) -> str:
        """space: byte-level, a space belongs to the word behind it. ends:
        lower case, words end in a mark, white space goes. whole: all others,
        which are encoded text by text."""
        model, before = said["model"], said["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
            return "whole"
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not said["normalizer"]:
            return "space"
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        parts = before.get("pretokenizers", [{}])
        if steps == ["NFC", "Replace", "Lowercase"] and model.get("end_of_word_suffix") and [x.get("type") for x in parts] == ["Split", "ByteLevel"]:
            return "ends"
        return "whole"

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text (n + 1)."""
        data, offsets = text_buffer(column)
        n = len(offsets) - 1
        odd = np.zeros(n, bool)
        raw = data.tobytes()
        if self.kind == "whole":
            odd[:] = True
        elif any(x in raw for x in (*self.signs, b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2", b"\xe1", b"\xe2", b"\xe3", b"\xef")):
            for i, t in enumerate(column.to_pylist()):
                odd[i] = t is not None and bool(ODD_SPACE.search(t) or self.special.search(t))
        starts, ends, plain, first = units(data, offsets)
        if self.kind == "ends":
            data = lowered(data)
            starts = starts + (plain & SPACE[data[starts]] if len(data) else 0)
        hashes = hash_spans(data, starts, ends)
        inverse, distinct = pd.factorize(hashes)
        where = np.empty(len(distinct), np.int64)
        where[inverse[::-1]] = np.arange(len(hashes) - 1, -1, -1)
        place = np.searchsorted(self.known, distinct)
        hit = np.zeros(len(distinct), bool)
        ok = place < len(self.known)
        hit[ok] = self.known[place[ok]] == distinct[ok]
        new = np.flatnonzero(~hit)
        flat, lengths = self._encode_units(raw, data, starts[where[new]], ends[where[new]], plain[where[new]])
        at = np.empty(len(distinct), np.int64)
        size = np.empty(len(distinct), np.int64)
        at[hit], size[hit] = self.known_at[place[hit]], self.known_size[place[hit]]
        at[new], size[new] = len(self.known_ids) + np.cumsum(lengths) - lengths, lengths
        pool = np.concatenate([self.known_ids, flat])
        seg_size = size[inverse]
        run, inner = spread(seg_size)
        ids = pool[at[inverse][run] + inner]
        doc = np.concatenate([[0], np.cumsum(seg_size)])[first]
        self._remember(distinct, at, size, pool, flat, new)
        if odd.any():
            pieces, marks = [], [0]
            for i in range(n):
                own = np.array(self.whole([column[i].as_py() or ""])[0], np.uint32) if odd[i] else ids[doc[i] : doc[i + 1]]
                pieces.append(own)
                marks.append(marks[-1] + len(own))
            ids, doc = np.concatenate(pieces), np.array(marks, np.int64)
        return ids, doc

    def _encode_units(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units: plain ones by the library's model at once,
        others with its normaliser and pre-tokenizer."""
        model, sizes = self.tokenizer.model, ends - starts
        run, inner = spread(sizes)
        mapped = data[starts[run] + inner].tobytes().decode("latin-1").translate(self.letters)
        tos = np.cumsum(sizes)
        found: list[list[int]] = [[]] * len(starts)
        hard = np.flatnonzero(~plain).tolist()
        for i, s, e, easy in zip(range(len(starts)), (tos - sizes).tolist(), tos.tolist(), plain.tolist()):
            if not easy or e == s:
                continue
            if self.kind == "ends" and "0" <= mapped[s] <= "9":
                found[i] = [t.id for x in mapped[s:e] for t in model.tokenize(x)]
            else:
                found[i] = [t.id for t in model.tokenize(mapped[s:e])]
        for i, ids in zip(hard, self.whole([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[hard].tolist(), ends[hard].tolist())])):
            found[i] = ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _remember(self, distinct, at, size, pool, flat, new) -> None:
        """Add what is new to the cache; it starts afresh beyond KEEP units."""
        if len(self.known) + len(new) <= KEEP:
            whole, self.known_ids = np.concatenate([self.known, distinct[new]]), pool
            at, size = np.concatenate([self.known_at, at[new]]), np.concatenate([self.known_size, size[new]])
        else:
            whole, self.known_ids, at, size = distinct[new], flat, at[new] - len(self.known_ids), size[new]
        order = np.argsort(whole, kind="stable")
        self.known, self.known_at, self.known_size = whole[order], at[order], size[order]


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; other bytes as they are."""
    out = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    out[lead + 1] = np.where((after >= 0x80) & (after <= 0x9E) & (after != 0x97), after + 0x20, after)
    return out


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, whether each lies in a plain segment, and
    each text's first unit."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool), np.zeros(len(offsets), np.int64)
    kind = KIND[data]
    lead = np.flatnonzero(kind == 4)  # of Latin-1's two bytes
    if len(lead):
        following = data[np.minimum(lead + 1, len(data) - 1)]
        kind[lead] = np.where((following == 0x97) | (following == 0xB7), 6, 1)
        kind[np.minimum(lead + 1, len(data) - 1)] = kind[lead]
    blank = kind == 0
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    cuts = offsets[:-1]
    begin[cuts[cuts < len(data)]] = True
    starts = np.flatnonzero(begin)
    complicated = np.maximum.reduceat(kind, starts) >= 5
    spaces = np.add.reduceat(blank.astype(np.int32), starts)
    opens = data[starts]
    plain = ~complicated & ((spaces == 0) | (spaces == 1) & ((opens == 32) | (opens == 10)))
    change = np.zeros(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[1:] &= ~(data[:-1] == 32)
    plain = np.repeat(plain, np.diff(np.append(starts, len(data))))
    change &= plain
    change[starts] = True
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], len(data)), plain[starts], np.searchsorted(starts, offsets)


def encoder(path: str) -> Encoder:
    """One encoder for each path and worker process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
