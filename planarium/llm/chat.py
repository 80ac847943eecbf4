"""Conversations laid out as training text, assembled column by column into one Arrow buffer.

A turn is written as `<s>role`, a line feed, the text, `</s>` and a line feed. Wherever a control string stands in a
role or text, or would if backslashes behind its first character were taken away, one backslash is put behind that
character; reading takes one away. So no control string survives inside a turn, and every text comes back exactly.
Loss spans cover what assistants say, in code points of the formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

#: Fixed values of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, BREAK, CLOSE = b"<s>", b"\n", b"</s>\n"
SPOKEN = "assistant"
#: Bytes of text that a task lays out at once.
BLOCK_BYTES = 8 << 20

_REST = "|".join(re.escape(c[0]) + r"(\\*)(?=" + re.escape(c[1:]) + ")" for c in CONTROL)
_ANY = re.compile(_REST)
_STUFFED = re.compile(_REST.replace(r"(\\*)", r"(\\+)"))


def escape(text: str) -> str:
    if "<" not in text and "[" not in text:
        return text
    return _ANY.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return _STUFFED.sub(lambda m: m.group()[0] + m.group()[2:], text) if "\\" in text else text


def assemble(segments: list[pa.Array], group: np.ndarray) -> pa.Array:
    """One string for each group of rows: row after row, segment after segment, copied into one buffer.

    segments are string columns of equal length; group gives each row's group, in order from 0, all of them used.
    """
    rows, kinds = len(group), len(segments)
    starts, sizes, pools, shift = np.zeros((rows, kinds), np.int64), np.zeros((rows, kinds), np.int64), [], 0
    for k, column in enumerate(segments):
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
        pool = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
        starts[:, k], sizes[:, k] = ends[:-1] + shift, np.diff(ends)
        pools.append(pool)
        shift += len(pool)
    pool = np.concatenate([*pools, np.zeros(0, np.uint8)])
    start, size = starts.reshape(-1), sizes.reshape(-1)
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    out = pa.allocate_buffer(total)
    index = np.arange(total) + np.repeat(start - (upto - size), size)
    np.take(pool, index, out=np.frombuffer(out, np.uint8) if total else np.zeros(0, np.uint8), mode="clip")
    groups = int(group[-1]) + 1 if rows else 0
    lengths = np.bincount(group, sizes.sum(1), groups).astype(np.int64) if rows else np.zeros(0, np.int64)
    return pa.LargeStringArray.from_buffers(groups, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64)), out)


def _plain(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def _lay_out(batch: pa.RecordBatch, carried: tuple[object, int] | None) -> tuple[pa.RecordBatch, tuple[object, int]]:
    ids = batch.column(0).to_pylist()
    roles, texts = _plain(batch.column(2)), _plain(batch.column(3))
    group = np.cumsum([0, *(a != b for a, b in zip(ids, ids[1:]))])
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    parts = [0] * len(first)
    if carried and carried[0] == (ids[0],):
        parts[0] = carried[1] + 1
    shown = [escape(r) for r in roles], [escape(t) for t in texts]
    fixed = [pa.array([x.decode()] * len(ids), pa.large_string()) for x in (OPEN, BREAK, CLOSE)]
    body = [pa.array(x, pa.large_string()) for x in shown]
    formatted = assemble([fixed[0], body[0], fixed[1], body[1], fixed[2]], group)
    role, text = (np.array([len(x) for x in y], np.int64) for y in shown)
    whole = role + text + len(OPEN) + len(BREAK) + len(CLOSE)
    at = np.cumsum(whole) - whole
    at = at - at[first][group] + len(OPEN) + role + len(BREAK)
    said = np.array([r == SPOKEN for r in roles], bool)
    spoken = np.flatnonzero(said)
    cuts = np.searchsorted(group[spoken], np.arange(len(first) + 1)).astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[spoken])) for x in (at, at + text)]
    out = pa.record_batch(
        [pa.array([ids[k] for k in first], pa.int64()), pa.array(parts, pa.int32()), formatted.cast(pa.string()), *spans],
        ["conv_id", "part", "formatted", "loss_start", "loss_end"],
    )
    return out, ((ids[-1],), parts[-1])


def format_chats(turns: DataFrame, tasks: int | None = None) -> DataFrame:
    """(conv_id, part, formatted, loss_start, loss_end) from rows conv_id, turn, role, text.

    The rows of a conversation follow turn, then role, then text, nulls first; equal rows all stay. A null role or text
    counts as empty; rows whose conv_id is null are one conversation. Most conversations are one row with part 0; one
    that is longer than a task's block goes on in parts 1, 2 and so on, each cut between turns. loss_start and loss_end
    are offsets in code points within the row's formatted. Other columns are not read; no rows give no rows.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        carried = None

        def laid(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal carried
            for batch in pa.Table.from_batches(rows).combine_chunks().to_batches():
                out, carried = _lay_out(batch, carried)
                yield out

        for batch in batches:
            at = 0
            while at < len(batch):  # blocks of bounded bytes, cut where a conversation ends if one does
                size = np.cumsum([len(x) for x in _plain(batch.column(3).slice(at))])
                to = at + max(1, int(np.searchsorted(size, BLOCK_BYTES, "right")))
                held.append(batch.slice(at, to - at))
                at = to
                if sum(x.nbytes for x in held) < BLOCK_BYTES:
                    continue
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                ids = rows.column(0).to_pylist()
                cut = next((k for k in range(len(ids) - 1, 0, -1) if ids[k] != ids[k - 1]), len(ids))
                yield from laid([rows.slice(0, cut)])
                held = [rows.slice(cut)] if cut < len(ids) else []
        if held:
            yield from laid(held)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition(tasks, "conv_id") if tasks else rows.repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow(ordered, step, "conv_id long, part int, formatted string, loss_start array<long>, loss_end array<long>")


_TURN = re.compile("<s>([^\n]*)\n(.*?)</s>\n", re.S)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn, read from formatted text. A role's own line feeds stay with its text's start."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), one row a conversation.

    Everything is read from what format_chats wrote: turns by the template's marks, loss text by the loss spans.
    turns_sha256 hashes role, line feed, text, line feed for each turn; loss_sha256 all text under the loss mask. A
    conversation's parts stream through its hashes in order, so none has to fit in memory as a whole. Null roles and
    texts were laid out as empty ones; rows that repeated are turns like any others; a null conv_id is a conversation of
    its own. Other columns are not read; no rows give no rows.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def done() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        def table() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

        for batch in batches:
            for row in range(len(batch)):
                conv, text = batch.column(0)[row].as_py(), batch.column(2)[row].as_py()
                if state is None or state[0] != conv:
                    if state:
                        out.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for a, b in zip(batch.column(3)[row].as_py(), batch.column(4)[row].as_py()):
                    said = unescape(text[a:b])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if out:
                yield table()
                out = []
        if state:
            out.append(done())
            yield table()

    ordered = chats.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return arrow(ordered, step, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
