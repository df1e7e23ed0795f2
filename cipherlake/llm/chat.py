"""Chat formatting by columnar byte assembly.

A turn is written ``### role: text</turn>`` and a newline. Inside a text a
backslash goes before every backslash, every start of ``###`` and every
``</turn>``; a role escapes the characters that could end it. A reader that
takes the character after a backslash as it is finds the turns again, whatever
their texts hold.

A batch of turns is assembled in numpy without touching single rows: escapes
found on the whole text buffer give segment lengths, running sums give offsets,
and bytes are scattered to one preallocated buffer that becomes an Arrow string
column, together with the byte span of each assistant text (the loss mask).

Scale: formatting is a narrow map. Digests by conversation stream the sorted
turns with one running state, so a conversation of any length takes the memory
of a batch.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HEAD, MARK, FOOT, ESCAPE = b"### ", b": ", b"</turn>\n", 92
_CLOSE = np.frombuffer(b"</turn>", np.uint8)
_TURN = re.compile(rb"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)
_IN_ROLE = re.compile(rb"([\\#:<\n])")
#: Source bytes that are scattered at a time.
STEP = 1 << 20


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings (null as empty) and their offsets, from 0."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def escapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted positions in ``data`` that need a backslash before them."""
    hashes = data == 35
    triple = np.flatnonzero(hashes[:-2] & hashes[1:-1] & hashes[2:]) if len(data) > 2 else np.empty(0, np.int64)
    close = np.flatnonzero(data == 60)
    close = close[close + len(_CLOSE) <= len(data)]
    close = close[(data[close[:, None] + np.arange(len(_CLOSE))] == _CLOSE).all(1)]

    def inside(at, size):
        return at[at + size <= offsets[np.searchsorted(offsets, at, "right")]]

    return np.sort(np.concatenate([np.flatnonzero(data == ESCAPE), inside(triple, 3), inside(close, len(_CLOSE))]))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, segment offsets, text spans in the buffer) of the formatted turns."""
    data, offsets = _bytes_of(texts)
    special = escapes(data, offsets)
    before = np.searchsorted(special, offsets)
    codes = roles.cast(pa.large_string()).fill_null("").dictionary_encode()
    heads = [HEAD + _IN_ROLE.sub(rb"\\\1", r.encode("utf-8", "surrogatepass")) + MARK for r in codes.dictionary.to_pylist()]
    code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    head = np.array([len(h) for h in heads], np.int64)[code]
    body = np.diff(offsets) + np.diff(before)
    ends = np.cumsum(head + body + len(FOOT))
    starts = np.concatenate([[0], ends])
    at = starts[:-1] + head
    out = np.empty(int(starts[-1]), np.uint8)
    for k, h in enumerate(heads):
        rows = np.flatnonzero(code == k)
        out[starts[rows][:, None] + np.arange(len(h))] = np.frombuffer(h, np.uint8)
    out[(at + body)[:, None] + np.arange(len(FOOT))] = np.frombuffer(FOOT, np.uint8)
    shift = at - offsets[:-1] - before[:-1]
    for a in range(0, len(data), STEP):
        pos = np.arange(a, min(a + STEP, len(data)))
        row = np.searchsorted(offsets, pos, "right") - 1
        out[pos + shift[row] + np.searchsorted(special, pos, "right")] = data[pos]
    out[special + shift[np.searchsorted(offsets, special, "right") - 1] + np.arange(len(special))] = ESCAPE
    return out, starts, np.stack([at, at + body], 1)


def read_back(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of every turn."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at byte {at}")
        turns.append((_ESCAPED.sub(rb"\1", m[1]), _ESCAPED.sub(rb"\1", m[2])))
        at = m.end()
    return turns


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end) of every row of ``conversations (conv_id, turn, role, text)``.

    ``formatted`` is the turn as written; the loss span is in its bytes and
    covers an assistant's text (null for other roles). Turns of a conversation
    in order, joined, are its formatted text. Null roles and texts are empty.
    """
    ids = ", ".join(f"{c} {conversations.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))

    def run(batches):
        for batch in batches:
            out, starts, spans = assemble(batch.column(2), batch.column(3))
            formatted = pa.LargeStringArray.from_buffers(len(spans), pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            mine = np.array([r == "assistant" for r in batch.column(2).to_pylist()], bool)
            loss = [pa.array(spans[:, k] - starts[:-1], pa.int64(), mask=~mine) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), formatted, *loss], ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"])

    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, f"{ids}, role string, formatted string, loss_start long, loss_end long")


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, segment: bytes, span: tuple[int, int] | None) -> None:
        for role, text in read_back(segment):
            self.turns.update(role + b"\n" + text + b"\n")
            self.n += 1
        self.chars += len(segment.decode("utf-8", "surrogatepass"))
        if span is not None:
            text = _ESCAPED.sub(rb"\1", segment[span[0] : span[1]])
            self.loss.update(text)
            self.loss_chars += len(text.decode("utf-8", "surrogatepass"))

    def row(self) -> list:
        return [self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """One row per conv_id, read back from the formatted turns: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns come by turn (null first), equal ones by role and text; repeated rows
    are turns of their own; a null conv_id is a conversation. Other columns are
    not read.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        now, state = None, None
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), []
            for a in range(0, len(ids), 512):
                roles, texts = batch.column(2).slice(a, 512), batch.column(3).slice(a, 512)
                out, starts, spans = assemble(roles, texts)
                whole = out.tobytes()
                for k, role in enumerate(roles.to_pylist()):
                    if state is None or ids[a + k] != now:
                        if state is not None:
                            done.append([now, *state.row()])
                        now, state = ids[a + k], _Digest()
                    first = int(starts[k])
                    state.add(whole[first : int(starts[k + 1])], (int(spans[k, 0]) - first, int(spans[k, 1]) - first) if role == "assistant" else None)
            yield _rows(done, batch.schema.field(0).type)
        if state is not None:
            yield _rows([[now, *state.row()]], batch.schema.field(0).type)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
