"""Ogg containers as media columns.

Writing: a payload becomes 8-bit mono samples at 8 kHz in one logical stream
(an identification packet, then packets of 4,096 samples), multiplexed with a
second logical stream of text marks, one for each second of sound. Pages carry
lacing values, granule positions (samples so far), serial numbers, page numbers
and the format's checksum (polynomial 04c11db7, not reflected).

Reading: pages are found by their capture pattern and verified by checksum;
packets are reassembled from lacing values across pages; logical streams are
told apart by serial number; each packet's time follows from granule positions
and the rate in the identification packet. A damaged page makes its stream's
unfinished packet void, is counted, and reading goes on at the next pattern.

Equal payloads give equal bytes. Null text is an empty one (64 zero bytes);
null media decode to null columns; repeated rows each get a row; an empty table
gives no rows; extra columns are left aside unless named to be kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

RATE = 8000
PACKET = 4096
#: A page holds at most 255 lacing values.
LACES = 255
IDENT = b"\x01LXPCM8\x00"
MARKS = b"\x01LXMARK\x00"
HEAD = struct.Struct("<4sBBqIIIB")
FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(data: bytes) -> int:
    """The checksum of Ogg pages. It is the mirror image of the reflected CRC
    of the bit-reversed bytes, with 0 as first value and no final inversion."""
    mirrored = zlib.crc32(data.translate(FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(FLIP), "big")


def page(kind: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(laces)) + laces
    crc = ogg_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


class Stream:
    """One logical stream's pages, from packets with granule positions."""

    def __init__(self, serial: int):
        self.serial, self.number, self.pages = serial, 0, []
        self.laces, self.body, self.granule, self.goes_on = bytearray(), bytearray(), -1, False

    def _emit(self, last: bool = False, goes_on: bool = False) -> None:
        kind = self.goes_on * 1 + (self.number == 0) * 2 + last * 4
        self.pages.append((self.granule, page(kind, self.granule, self.serial, self.number, bytes(self.laces), bytes(self.body))))
        self.number += 1
        self.laces, self.body, self.granule, self.goes_on = bytearray(), bytearray(), -1, goes_on

    def packet(self, data: bytes, granule: int, alone: bool = False) -> None:
        values = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while at < len(values):
            if len(self.laces) == LACES:
                self._emit(goes_on=at > 0)
            take = values[at : at + LACES - len(self.laces)]
            self.laces += take
            self.body += data[at * 255 : (at + len(take)) * 255]
            at += len(take)
        self.granule = granule
        if alone:
            self._emit()

    def finish(self) -> None:
        self._emit(last=True)


def mux(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg file of the payload's samples, with marks for each second."""
    serial = zlib.crc32(payload)
    sound, marks = Stream(serial), Stream(serial ^ 0xFFFFFFFF)
    sound.packet(IDENT + struct.pack("<IQQ", RATE, n_bytes, len(payload)), 0, alone=True)
    marks.packet(MARKS + struct.pack("<I", RATE), 0, alone=True)
    for at in range(0, len(payload), PACKET):
        piece = payload[at : at + PACKET]
        sound.packet(piece, at + len(piece))
    for second in range(-(-len(payload) // RATE)):
        marks.packet(b"t=%d" % second, second * RATE)
    sound.finish()
    marks.finish()
    return b"".join(_interleaved(sound.pages, marks.pages))


def _interleaved(a: list[tuple[int, bytes]], b: list[tuple[int, bytes]]) -> Iterator[bytes]:
    """All first pages first, then by granule position; each stream in order."""
    yield a[0][1]
    yield b[0][1]
    i, j = 1, 1
    while i < len(a) or j < len(b):
        if j >= len(b) or i < len(a) and a[i][0] <= b[j][0]:
            yield a[i][1]
            i += 1
        else:
            yield b[j][1]
            j += 1


def pages_of(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes] | None]:
    """(kind, granule, serial, number, laces, body) of each sound page; None for
    a damaged one, after which reading goes on at the next capture pattern."""
    at = 0
    while at < len(data):
        if data[at : at + 4] == b"OggS" and len(data) - at >= 27:
            _, version, kind, granule, serial, number, crc, count = HEAD.unpack_from(data, at)
            laces = data[at + 27 : at + 27 + count]
            end = at + 27 + count + sum(laces)
            if version == 0 and len(laces) == count and end <= len(data):
                raw = data[at:end]
                if ogg_crc(raw[:22] + b"\0\0\0\0" + raw[26:]) == crc:
                    yield kind, granule, serial, number, laces, raw[27 + count :]
                    at = end
                    continue
        yield None
        at = data.find(b"OggS", at + 1)
        if at < 0:
            return


def demux(data: bytes) -> tuple[dict[int, list[tuple[bytes, int]]], dict[str, int]]:
    """Packets of each logical stream, with the granule position of the page on
    which each ends (-1: none ends there with one), and counts."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    parts: dict[int, list[bytes] | None] = {}
    numbers: dict[int, int] = {}
    counts = {"pages": 0, "damaged": 0, "lost": 0}
    for found in pages_of(data):
        if found is None:
            counts["damaged"] += 1
            continue
        kind, granule, serial, number, laces, body = found
        counts["pages"] += 1
        packets = streams.setdefault(serial, [])
        if number != numbers.get(serial, -1) + 1:
            counts["lost"] += 1
            parts[serial] = None
        numbers[serial] = number
        open_part = parts.get(serial)
        if not kind & 1:
            open_part = []
        at, begin = 0, 0
        for lace in laces:
            at += lace
            if lace < 255:
                if open_part is not None:
                    packets.append((b"".join(open_part) + body[begin:at] if open_part else body[begin:at], granule))
                open_part, begin = [], at
        if begin < at and open_part is not None:
            open_part = [*open_part, body[begin:at]]
        parts[serial] = open_part
    return streams, counts


def decode(media: bytes) -> dict:
    """The payload and what the container says of it."""
    streams, counts = demux(media)
    out = {"payload": None, "n_bytes": None, "packets": 0, "marks": 0, "seconds": 0.0, "streams": len(streams), **counts}
    for packets in streams.values():
        first = packets[0][0] if packets else b""
        if first.startswith(IDENT):
            rate, n_bytes, length = struct.unpack_from("<IQQ", first, len(IDENT))
            sound = b"".join(p for p, _ in packets[1:])
            if len(sound) == length:
                out["payload"], out["n_bytes"] = sound, n_bytes
            out["packets"] = len(packets) - 1
            # A packet ends at its page's granule position less the samples of the packets behind it there.
            times = packet_ends(packets[1:])
            out["seconds"] = (times[-1] if times else 0) / rate
        elif first.startswith(MARKS):
            out["marks"] = len(packets) - 1
    return out


def packet_ends(packets: list[tuple[bytes, int]]) -> list[int]:
    """The granule position at which each packet ends: the last of a page has
    the page's, those before it on the page fewer by the samples that follow."""
    ends, behind, page_granule = [0] * len(packets), 0, None
    for i in range(len(packets) - 1, -1, -1):
        data, granule = packets[i]
        if granule != page_granule:
            page_granule, behind = granule, 0
        ends[i] = granule - behind
        behind += len(data)
    return ends


def feature(payload: bytes, said: dict) -> str:
    """Figures of the decoded sound: duration, pages, packets, marks, mean and
    power of the samples about 128, zero crossings and the 16-bin histogram."""
    samples = np.frombuffer(payload, np.uint8)
    centred = samples.astype(np.int16) - 128
    power = int((centred.astype(np.int32) ** 2).sum(dtype=np.int64))
    signs = centred >= 0
    crossings = int(np.count_nonzero(signs[1:] != signs[:-1]))
    bins = np.bincount(samples >> 4, minlength=16)
    return f"s={said['seconds']:.6f};pages={said['pages']};packets={said['packets']};marks={said['marks']};sum={int(centred.sum(dtype=np.int64))};power={power};zc={crossings};h=" + ".".join(map(str, bins.tolist()))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def _fields(df: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def encode_media(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and media (the Ogg bytes) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raws = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = pa.array([mux(padded(r), len(r)) for r in raws], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), media], names=[*keep, "media"])

    return docs.select(*keep, "text").mapInArrow(run, f"{_fields(docs, keep)}, media binary")


def describe_media(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Digests and features of the payloads, read back from the Ogg bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_described(m) for m in batch.column("media")]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), KINDS)] if rows else [pa.array([], k) for k in KINDS]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *NAMES])

    return media.select(*keep, "media").mapInArrow(run, f"{_fields(media, keep)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _described(cell: pa.Scalar) -> tuple:
    if not cell.is_valid:
        return (None,) * len(NAMES)
    media = cell.as_py()
    said = decode(media)
    payload = said["payload"]
    whole = (len(media), hashlib.sha256(media).hexdigest())
    if payload is None:
        return (None, None, None, None, *whole, f"damaged={said['damaged']};lost={said['lost']}")
    return (said["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *whole, feature(payload, said))
