"""Chat formatting by columnar byte assembly.

Each Arrow batch of turns is laid out as a matrix of byte segments (header, role,
separator, text, footer). Segment lengths give cumulative offsets, these give scatter
indices, and one numpy scatter copies all segments into one preallocated buffer, which
becomes the Arrow column without another copy.

A turn is written as ``<s>[INST]role\\ntext[/INST]</s>``. Control strings inside a text
get a backslash after their first character (and one more where backslashes already
stand there), so that no text can forge a mark and the original can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template, without their first character.
_TAILS = ("s>", "/s>")
_INST_TAILS = ("INST\\]", "/INST\\]")
HEAD, MIDDLE, FOOT = b"<s>[INST]", b"\n", b"[/INST]</s>"

_ESCAPE = r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])"
_UNESCAPE = re.compile(r"(<)(\\*)\\(/?s>)|(\[)(\\*)\\(/?INST\])")
_TURN = re.compile(r"<s>\[INST\]([^\n]*)\n(.*?)\[/INST\]</s>", re.DOTALL)

FORMATTED = "conv_id long, piece long, formatted string, n_turns long, mask array<struct<start:long,end:long>>"


def escape_texts(texts: pa.Array) -> pa.Array:
    """Marks control strings inside texts; other texts stay as they are."""
    return pc.replace_substring_regex(texts, _ESCAPE, r"\1\4\\\2\5\3\6")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def _escape_roles(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape_texts(roles)


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def _bytes_and_lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the length of each value."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def assemble(parts: list[bytes | pa.Array], rows: int) -> tuple[pa.Buffer, np.ndarray]:
    """One buffer that holds, row after row, each row's parts in order.

    `parts` are constants or string columns of `rows` values. Returns the buffer and the
    rows x parts matrix of segment ends in it.
    """
    columns = [_bytes_and_lengths(p) if isinstance(p, pa.Array) else (np.frombuffer(p, np.uint8), None) for p in parts]
    lengths = np.empty((rows, len(parts)), np.int64)
    for k, (data, each) in enumerate(columns):
        lengths[:, k] = len(data) if each is None else each
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = pa.allocate_buffer(int(ends[-1, -1]) if rows else 0)
    target = np.frombuffer(out, np.uint8)
    for k, (data, each) in enumerate(columns):
        if each is None:
            target[(starts[:, k, None] + np.arange(len(data))).ravel()] = np.tile(data, rows)
        elif len(data):
            source_starts = np.cumsum(each) - each
            index = np.arange(len(data), dtype=np.int64) + np.repeat(starts[:, k] - source_starts, each)
            target[index] = data
    return out, ends


def _format_rows(batch: pa.RecordBatch, piece_bytes: int) -> Iterator[tuple]:
    """(conv_id, buffer slice as Arrow values) pieces of one batch of sorted turns."""
    n = batch.num_rows
    conv = batch.column("conv_id")
    ids = np.asarray(conv.fill_null(0).to_numpy(zero_copy_only=False))
    nulls = np.asarray(conv.is_null().to_numpy(zero_copy_only=False))
    roles, texts = batch.column("role"), batch.column("text")
    buffer, ends = assemble([HEAD, _escape_roles(roles), MIDDLE, escape_texts(texts), FOOT], n)
    row_ends = ends[:, -1]
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])
    firsts = np.flatnonzero(new)
    # a conversation longer than a piece is split between turns
    cuts: list[int] = []
    for a, b in zip(firsts, [*firsts[1:], n], strict=True):
        cuts.append(int(a))
        base = row_ends[a - 1] if a else 0
        while row_ends[b - 1] - base > piece_bytes:
            step = int(np.searchsorted(row_ends[a:b], base + piece_bytes, "right"))
            a = a + max(1, step)
            if a >= b:
                break
            cuts.append(int(a))
            base = row_ends[a - 1]
    cut = np.array(cuts)
    offsets = np.concatenate([[0], row_ends[np.append(cut[1:], n) - 1]]).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(offsets), buffer)
    # code-point positions of assistant texts in their piece, for the loss mask
    lead = (np.frombuffer(buffer, np.uint8) & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead)])
    mask_from, mask_to = points[ends[:, 2]], points[ends[:, 3]]
    assistant = np.asarray(pc.equal(roles, "assistant").to_numpy(zero_copy_only=False))
    piece_of = np.searchsorted(cut, np.arange(n), "right") - 1
    shift = points[offsets[:-1]][piece_of]
    rows = np.flatnonzero(assistant)
    counts = np.bincount(piece_of[rows], minlength=len(cut))
    spans = pa.StructArray.from_arrays(
        [pa.array(mask_from[rows] - shift[rows]), pa.array(mask_to[rows] - shift[rows])], ["start", "end"]
    )
    masks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
    turns = np.diff(np.append(cut, n))
    yield conv.take(pa.array(cut)), strings, turns, masks


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text, one row at least: assembly takes several indices a byte."""
    sizes = pc.add(pc.binary_length(batch.column("text")), pc.binary_length(batch.column("role")))
    ends = np.cumsum(np.asarray(sizes, np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _format_batches(batches: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[pa.RecordBatch]:
    previous, number = object(), 0
    for batch in (part for whole in batches for part in _slices(whole, 2 * piece_bytes)):
        for conv, strings, turns, masks in _format_rows(batch, piece_bytes):
            numbers = []
            for value in conv.to_pylist():
                number = number + 1 if value == previous else 0
                previous = value
                numbers.append(number)
            yield pa.RecordBatch.from_arrays(
                [conv, pa.array(numbers, pa.int64()), strings.cast(pa.string()), pa.array(turns, pa.int64()), masks],
                ["conv_id", "piece", "formatted", "n_turns", "mask"],
            )


def format_chat(turns: DataFrame, piece_bytes: int = 4 << 20) -> DataFrame:
    """Formats conversations: rows (conv_id, piece, formatted, n_turns, mask).

    `turns` has conv_id, turn, role and text; other columns are ignored. Turns are ordered
    by turn, then role, then text, so repeated rows and ties have one order. A null role or
    text is empty, a null turn comes first, a null conv_id is a conversation of its own. An
    empty table gives no rows. `mask` spans, in code points of `formatted`, the (escaped)
    assistant texts that a loss would cover. Pieces of a conversation concatenate to it in
    order of `piece`: most have one; one that is longer than `piece_bytes` or that crosses
    an Arrow batch has several, so no task holds a whole long conversation in memory. Rows
    of a conversation stand together and in order within a partition.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lambda it: _format_batches(it, piece_bytes), FORMATTED)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Reads (role, text, start, end) of each turn back from formatted text."""
    for m in _TURN.finditer(formatted):
        yield _unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.string() if "sha256" in x else pa.int64() for x in names]
    state: list | None = None
    done: list[tuple] = []

    def close() -> None:
        if state is not None:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[] for _ in names]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for conv, piece, formatted, mask in zip(
            *(batch.column(c).to_pylist() for c in ("conv_id", "piece", "formatted", "mask")), strict=True
        ):
            if piece == 0:
                close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in read_turns(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in mask:
                text = unescape(formatted[span["start"] : span["end"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
        if len(done) > 5000:
            yield flush()
    close()
    yield flush()


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the rows of format_chat.

    Works in the order that format_chat leaves, without another shuffle, and hashes piece
    by piece, so memory does not grow with a conversation. A null conv_id is one of them;
    an empty table gives no rows.
    """
    return formatted.mapInArrow(_digest_batches, DIGESTS)
