"""Chat formatting by columnar byte assembly.

Each turn is ``<|im_start|>role`` LF ``text<|im_end|>`` LF. Control strings of
common templates inside roles and texts are broken by a backslash behind their
first character, and backslashes are doubled, so a text can't open or close a
turn and comes back exactly; a line feed in a role becomes a backslash and n.

For a batch of turns sorted by conversation, numpy computes the lengths of all
segments (header, content, footer), their cumulative offsets and, for every
content byte, its scatter index; headers and contents are copied into one
preallocated buffer that becomes the Arrow column. Spans under the loss mask
(assistant texts) are offsets in code points of the formatted string.

Turns go by turn, then role and text (nulls first); a null role or text is an
empty one; conversations of a null conv_id form one conversation; repeated rows
stay repeated turns. A conversation comes out as one row, or, where it is
longer than ``PART_BYTES``, as consecutive parts, so that no task ever holds an
unbounded conversation; parts are cut between turns. An empty table gives no
rows; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, slices, spread, text_buffer

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of public chat templates (fixed values).
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
SUSPECT = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
UNESCAPE = re.compile(r"\\(.)", re.S)
#: Formatted bytes at which a conversation's next part begins.
PART_BYTES = 64 << 20


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\")) if SUSPECT.search(text) else text


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role) if "\\" in role else role


def escaped(column: pa.Array) -> pa.Array:
    """The column's texts, escaped; only those that hold a suspect are touched."""
    texts = column.fill_null("")
    data, _ = text_buffer(texts)
    if not np.isin(data, (60, 91, 92)).any():
        return texts
    return pa.array([escape(t) for t in texts.to_pylist()], pa.string())


def assemble(roles: list[str], contents: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all formatted turns, the turns' offsets in it (n + 1), and
    the offsets and lengths of the contents."""
    data, offsets = text_buffer(contents)
    names = sorted(set(roles))
    headers = [f"{OPEN}{escape_role(r)}\n".encode() for r in names]
    code = np.fromiter((names.index(r) for r in roles), np.int64, len(roles)) if len(names) < 32 else np.searchsorted(names, roles)
    head = np.fromiter(map(len, headers), np.int64, len(headers))
    close = np.frombuffer(CLOSE.encode(), np.uint8)
    sizes = np.diff(offsets)
    turn = head[code] + sizes + len(close)
    at = np.concatenate([[0], np.cumsum(turn)])
    out = np.empty(int(at[-1]), np.uint8)
    for i, h in enumerate(headers):
        places = at[:-1][code == i]
        out[places[:, None] + np.arange(len(h))] = np.frombuffer(h, np.uint8)
    out[(at[1:] - len(close))[:, None] + np.arange(len(close))] = close
    begin = at[:-1] + head[code]
    run, inner = spread(sizes)
    out[begin[run] + inner] = data
    return out, at, begin, sizes


def format_conversations(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, formatted and loss (array<struct<start, end>>, code points
    of the part, end exclusive) of all conversations in ``turns``."""
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    rows = rows.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")))
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, loss, size, chars = None, 0, [], [], 0, 0
        started = False

        def flush() -> pa.RecordBatch:
            text = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, size], np.int32)), pa.py_buffer(b"".join(held))])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([part], pa.int32()), text, pa.array([loss], kinds)], names=["conv_id", "part", "formatted", "loss"])

        for batch in batches:
            for piece in slices(batch, "text", min(STEP_BYTES, part_bytes)):
                convs = piece.column("conv_id").to_pylist()
                roles = [r or "" for r in piece.column("role").to_pylist()]
                buffer, at, begin, sizes = assemble(roles, escaped(piece.column("text")))
                # Code points before each byte: bytes that don't continue one.
                points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
                n, first = len(convs), 0
                while first < n:
                    last = first
                    while last < n and convs[last] == convs[first]:
                        last += 1
                    if started and (convs[first] != now):
                        yield flush()
                        held, loss, size, chars, part = [], [], 0, 0, 0
                    elif size > part_bytes:
                        yield flush()
                        held, loss, size, chars, part = [], [], 0, 0, part + 1
                    now, started = convs[first], True
                    base = points[at[first]] - chars
                    for t in range(first, last):
                        if roles[t] == "assistant":
                            loss.append({"start": int(points[begin[t]] - base), "end": int(points[begin[t] + sizes[t]] - base)})
                    held.append(buffer[at[first] : at[last]].tobytes())
                    size += int(at[last] - at[first])
                    chars += int(points[at[last]] - points[at[first]])
                    first = last
        if started:
            yield flush()

    return rows.mapInArrow(run, "conv_id long, part int, formatted string, loss array<struct<start:long,end:long>>")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted string."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("no turn where one should begin")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line + 1)
        yield unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])
        at = end + len(CLOSE)


def read_back(formatted: DataFrame, dealt: bool = False) -> DataFrame:
    """Digest columns, read from the formatted strings and loss spans alone.
    ``dealt``: a conversation's parts already follow each other in a partition,
    as format_conversations leaves them."""
    parts = formatted if dealt else formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, state, started = None, None, False
        out: list[tuple] = []

        def close() -> None:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            out_ = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(out_, names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                conv, text = batch.column("conv_id")[i].as_py(), batch.column("formatted")[i].as_py()
                if not started or conv != now:
                    if started:
                        close()
                    now, started, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in batch.column("loss")[i].as_py() or []:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield batch_of()
        if started:
            close()
        yield batch_of()

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
