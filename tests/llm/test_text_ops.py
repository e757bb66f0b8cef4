"""Chat formatting, media, tokens, packing, decontamination: exact round trips
and brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from lexigraph.llm import chat, decontam, media, packing, token_output  # noqa: E402
from lexigraph.llm.tokens import Encoder  # noqa: E402

DOC = "doc_id long, text string, source string, n_tokens string"
TEXTS = ["", None, "a b c", "  two  spaces ", "x\n\ny", "don't  stop's 'em", "été à Ôté 12,5€", "中文 abc12", "\x1c\x85 odd   b", "<|endoftext|> </s>", "a <|endoftext|> b<|startoftext|><|EndOfText|>", "İstanbul ΣΑΣ", "a" * 5000, "word " * 3000, "\t tab\tx\r\ny", "é combining"]


def docs(spark, texts, schema=DOC):
    return spark.createDataFrame([(i, t, "s", "clash") for i, t in enumerate(texts)], schema)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    """Held against a tokenizer of its own, with the library's settings."""
    code, own = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    draw = random.Random(1)
    texts = TEXTS + ["".join(draw.choice("aB é'\n  1.,_ß×÷µ中́ ") for _ in range(draw.randrange(40))) for _ in range(400)]
    for _ in range(2):  # the second time from the cache
        ids, at = code.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == own.encode(t or "", add_special_tokens=False).ids, t


def test_special_strings_are_the_librarys():
    ids, at = Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(pa.array(["a <|endoftext|> b", "a b"]))
    assert ids[: at[1]].tolist() == [64, 220, 50256, 275]


def test_elias_fano():
    draw = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 10**9), (700, 5), (1000, 10**6), (3, 0)):
        values = np.sort(draw.integers(0, top + 1, n))
        coded, used = token_output.EliasFano.read(memoryview(token_output.EliasFano.of(values).to_bytes()))
        assert coded.select(0, n).tolist() == values.tolist()
        assert all(coded.select(i, j).tolist() == values[i:j].tolist() for i, j in ((0, 0), (n - 1, n), (n // 2, n), (n // 3, n // 2 + 1)))
    wide = np.cumsum(draw.integers(1, 2000, 100_000))
    assert len(token_output.EliasFano.of(wide).to_bytes()) < 0.22 * 8 * len(wide)


def library_ids(name, texts, end_id):
    own = Tokenizer.from_file(public_tokenizers.path(name))
    return [own.encode(t or "", add_special_tokens=False).ids + [end_id] for t in texts]


@pytest.mark.parametrize("segment", [None, 20])
def test_token_files(spark, monkeypatch, segment):
    if segment:  # several segments to a range
        monkeypatch.setattr(token_output, "SEGMENT_IDS", segment)
    TEXTS = globals()["TEXTS"] * (6 if segment else 1)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs(spark, TEXTS).union(docs(spark, TEXTS).filter("doc_id = 2")).repartition(3)
    folder = token_output.write_tokens(rows, path, 2)
    out = token_output.read_tokens(spark, folder).collect()
    ids, at, expected = library_ids("word_bpe_49k.json", TEXTS, 2), 0, []
    for i in [*range(3), *range(2, len(TEXTS))]:
        expected.append((i, at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        at += len(ids[i])
    assert sorted(map(tuple, out)) == expected
    if segment:
        assert spark.read.parquet(f"{folder}/segments").filter("part > 0").count() > 3
    empty = spark.createDataFrame([], DOC)
    assert token_output.read_tokens(spark, token_output.write_tokens(empty, path, 2)).count() == 0


def test_rows_without_doc_id_are_dealt_to_many_ranges(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["word %d of %d" % (i, i * i) for i in range(1000)] + ["x", "y y", ""]
    rows = spark.createDataFrame([(None if i < 1000 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    folder = token_output.write_tokens(rows, path, 2)
    stored = spark.read.parquet(f"{folder}/segments").groupBy("range").sum("n_docs").collect()
    assert len(stored) >= 8 and max(r[1] for r in stored) < 300
    out = sorted(token_output.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None] * 1000 + [1000, 1001, 1002]
    ids = library_ids("word_bpe_49k.json", texts, 2)
    assert sorted(r["ids_crc32"] for r in out) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids)
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    assert at == sum(map(len, ids))


def test_segments_refuse_other_bytes():
    with pytest.raises(ValueError):
        token_output.read_segment(b"nope" + bytes(60))


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs(spark, TEXTS)
    out = packing.pack(rows, path, capacity=512).collect()
    ids = dict(enumerate(library_ids("byte_bpe_50k.json", TEXTS, 1)))
    covered, sequences = collections.Counter(), collections.defaultdict(list)
    for r in out:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"], r["padded_tokens"]))
    assert covered == {i: len(v) for i, v in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length, total, padded in sorted(parts):
            assert offset == at
            at += length
        assert at == total <= 512 and padded == (total if total & (total - 1) == 0 else 512)
    assert packing.pack(spark.createDataFrame([], DOC), path).count() == 0


def test_rows_without_doc_id_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(None, "the same text", 1)] * 1500 + [(7, "a b c " * 40_000, 1)], "doc_id long, text string, length int")
    out = packing.pack(rows, path).collect()
    ids = library_ids("byte_bpe_50k.json", ["the same text", "a b c " * 40_000], 1)
    assert sum(r["length"] for r in out) == 1500 * len(ids[0]) + len(ids[1])
    groups = collections.Counter(r["sequence_id"] >> 32 for r in out)
    assert len(groups) >= 15 and max(groups.values()) < 300  # the long text's pieces too
    assert sorted(r["start"] for r in out if r["doc_id"] == 7) == list(range(0, len(ids[1]), 2048))
    again = packing.pack(rows, path).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_first_fit_equals_scan():
    draw = np.random.default_rng(5)
    lengths = draw.integers(1, 101, 500)
    sequence, offset = packing.first_fit_decreasing(lengths, 100)
    room, expected = [], np.empty(500, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        for k, r in enumerate(room):
            if r >= lengths[i]:
                break
        else:
            room.append(100)
            k = len(room) - 1
        expected[i] = k
        assert offset[i] == 100 - room[k]
        room[k] -= lengths[i]
    assert sequence.tolist() == expected.tolist()


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "system", "be \\ kind"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\n\\<"), (1, 3, "assistant", "é🙂"), (2, 0, "user", ""), (None, 0, None, "x"), (None, 1, "a\nb\\n[INST]", "<<SYS>> <|im_start"), (-7, 0, "user", said), (-7, 1, "assistant", said), (3, 5, "user", "same"), (3, 5, "user", "same")]
    rows = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(rows)
    for r in made.collect():
        inner = [t for t in turns if t[0] == r["conv_id"]]
        assert list(chat.parse(r["formatted"])) == [(t[2] or "", t[3] or "") for t in inner]
        for control in ("[INST]", "</s>", "<<SYS>>"):
            assert control not in r["formatted"]
        assert r["formatted"].count(chat.OPEN) == r["formatted"].count(chat.CLOSE) == len(inner)
        masked = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]]
        assert masked == [t[3] for t in inner if t[2] == "assistant"]
    for dealt in (True, False):
        out = {r["conv_id"]: r for r in chat.read_back(made, dealt).collect()}
        assert set(out) == {1, 2, 3, None, -7}
        loss = turns[2][3] + turns[3][3]
        assert (out[1]["n_turns"], out[1]["loss_chars"], out[1]["loss_sha256"]) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert out[1]["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3] or ''}\n" for t in turns[:4]).encode()).hexdigest()
        assert out[3]["n_turns"] == 2 and out[2]["loss_chars"] == 0
    assert chat.read_back(chat.format_conversations(rows.filter("false"))).count() == 0


def test_long_conversations_come_in_parts(spark):
    rows = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", "é<s>" * 20_000) for i in range(40)] + [(2, 0, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    whole, made = chat.format_conversations(rows), chat.format_conversations(rows, part_bytes=300_000)
    assert made.filter("conv_id = 1").count() >= 10 and whole.count() == 2
    assert made.filter("conv_id = 1").agg({"part": "max"}).first()[0] == made.filter("conv_id = 1").count() - 1
    for dealt in (True, False):
        assert sorted(map(tuple, chat.read_back(made, dealt).collect())) == sorted(map(tuple, chat.read_back(whole, dealt).collect()))
    out = {r["conv_id"]: r for r in chat.read_back(made).collect()}[1]
    assert (out["n_turns"], out["loss_chars"]) == (40, 20 * 80_000)


def test_escapes():
    draw = random.Random(2)
    parts = [*chat.CONTROLS, "\\", "<", "[", "a", "\n", "|>", "/"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(8)))
        assert chat.unescape(chat.escape(text)) == text
        assert chat.unescape_role(chat.escape_role(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
        assert "\n" not in chat.escape_role(text)


def test_ogg_checksum():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"\x00", b"OggS", bytes(range(256)) * 3):
        assert media.ogg_crc(data) == slow(data)


def slow_feature(payload, said):
    """The feature's figures, sample by sample; pages and packets as said."""
    levels = [b - 128 for b in payload]
    bins = collections.Counter(b // 16 for b in payload)
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(levels, levels[1:]))
    counted = re.match(r"[^;]*;(pages=\d+;packets=\d+);", said)[1]
    assert counted.endswith(f"packets={-(-len(payload) // 4096)}")
    return f"s={len(payload) / 8000:.6f};{counted};marks={-(-len(payload) // 8000)};sum={sum(levels)};power={sum(x * x for x in levels)};zc={crossings};h=" + ".".join(str(bins[i]) for i in range(16))


def slow_ogg(data):
    """The samples of the first logical stream, page by page by the format's book."""
    at, serial, packet, packets = 0, None, b"", []
    while at < len(data):
        assert data[at : at + 4] == b"OggS" and data[at + 4] == 0
        own = int.from_bytes(data[at + 14 : at + 18], "little")
        serial = own if serial is None else serial
        laces = data[at + 27 : at + 27 + data[at + 26]]
        end = at + 27 + len(laces) + sum(laces)
        crc = 0
        for b in data[at : at + 22] + bytes(4) + data[at + 26 : end]:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        assert crc == int.from_bytes(data[at + 22 : at + 26], "little")
        body = at + 27 + len(laces)
        for lace in laces if own == serial else ():
            packet += data[body : body + lace]
            body += lace
            if lace < 255:
                packets.append(packet)
                packet = b""
        at = end
    return b"".join(packets[1:])


def test_media(spark):
    texts = [*TEXTS, "z" * 70_000, "é" * 200_000, "y" * 64, "y" * 255, "y" * 4096 * 17]
    stored = media.encode_media(docs(spark, texts))
    out = {r["doc_id"]: r for r in media.describe_media(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["feature"] == slow_feature(payload, r["feature"])
    cells = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for i, r in out.items():
        assert (r["media_bytes"], r["media_sha256"]) == (len(cells[i]), hashlib.sha256(cells[i]).hexdigest())
    for i in (0, 3, 7, len(texts) - 1):  # read by a reader of its own
        raw = (texts[i] or "").encode()
        assert slow_ogg(cells[i]) == raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    twice = spark.createDataFrame([(1, "same", "mine", "x"), (1, "same", "mine", "y"), (None, "same", None, "z")], "doc_id long, text string, feature string, media string")
    found = media.describe_media(media.encode_media(twice)).collect()
    assert len(found) == 3 and len({tuple(r)[1:] for r in found}) == 1 and sorted(str(r["doc_id"]) for r in found) == ["1", "1", "None"]
    assert media.describe_media(stored.filter("false")).count() == 0


def test_ogg_streams_and_damage():
    payload = bytes(random.Random(4).randrange(256) for _ in range(150_016))
    whole = media.mux(payload, 150_000)
    streams, counts = media.demux(whole)
    assert len(streams) == 2 and counts["damaged"] == counts["lost"] == 0
    said = media.decode(whole)
    assert said["payload"] == payload and said["n_bytes"] == 150_000 and said["marks"] == 19
    broken = bytearray(whole)
    broken[len(whole) // 2] ^= 1
    said = media.decode(bytes(broken))
    assert said["payload"] is None and said["damaged"] >= 1 and said["lost"] >= 1
    assert media.decode(b"garbage" + whole)["payload"] == payload
    packets = [(b"ab", 2), (b"abc", 9), (b"abcd", 9)]
    assert media.packet_ends(packets) == [2, 5, 9]


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute_hits(texts, items, window=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOW))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(i)
    for d, t in texts:
        w, hit, own = WORDS.findall((t or "").translate(LOW)), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    own |= windows[tuple(w[j : j + k])]
                    hit.update(range(j, j + k))
        names = ",".join(sorted(map(str, own)))
        yield d, len(w), len(hit), len(own), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [None, 40])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    draw = random.Random(6)
    vocabulary = ["a", "b", "the", "Été", "x1", "中文"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.randrange(0, 14))) for i in range(12)] + [(100, None), (101, "--"), (5, "a b the a b the a b the a b the")]
    texts = [(i, text(draw.randrange(0, 700))) for i in range(30)]
    texts += [(30, None), (31, ""), (32, ". ".join(t or "" for _, t in items)), (32, "same id"), (33, "A-B, THE a_b the A b the a b the")]
    rows = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    if block:
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    expected = sorted(brute_hits(texts, items))
    assert sorted(map(tuple, decontam.contamination_report(rows, bench).collect())) == expected
    kept = decontam.without_contaminated(rows, bench)
    assert kept.columns == rows.columns
    twins = [(5, "x y z " * 16), (5, "a b the a b the a b the a b the " * 4), (5, "x y z " * 16)]
    same = spark.createDataFrame(twins, "doc_id long, text string")
    assert sorted(map(tuple, decontam.contamination_report(same, bench).collect())) == sorted(brute_hits(twins, items))
    assert decontam.without_contaminated(same, bench).count() == 2
    assert sorted(r["doc_id"] for r in kept.collect()) == [e[0] for e in expected if not e[5]]
    assert decontam.contamination_report(rows, bench.filter("false")).filter("contaminated").count() == 0
    assert decontam.contamination_report(rows.filter("false"), bench).count() == 0
