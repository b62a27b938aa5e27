"""Chat formatting: conversations as marked text with a loss mask.

A turn is written as `### role: text </turn>` and a line break. Inside roles and texts a backslash stands before every
backslash, `###`, `</turn>` and (in roles) colon, so the text can be read back exactly. The mask covers the escaped texts
of assistant turns.

Rows are dealt by conversation and sorted by turn, then streamed: each Arrow batch is assembled column by column. Segment
lengths, cumulative offsets and scatter indices are computed in numpy, and headers and contents are copied into one
preallocated buffer. A batch gives one block of each conversation in it, so a long conversation is many blocks and no task
holds a whole one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"
TRAINED = "assistant"
#: Bytes of contents that are assembled at a time, about.
BLOCK_BYTES = 4 << 20
BLOCKS = "conv_id bigint, block bigint, formatted string, turns int, loss_start array<int>, loss_end array<int>"
_KIND = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("formatted", pa.string()), ("turns", pa.int32()), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))])
_ROLE = regex.compile(r"### ((?:[^\\:]+|\\.)*+): ", regex.DOTALL)
_ESCAPED = regex.compile(r"\\(.)", regex.DOTALL)


def escape(texts: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(pc.replace_substring(pc.replace_substring(texts, "\\", "\\\\"), "###", "\\###"), "</turn>", "\\</turn>")
    return pc.replace_substring(out, ":", "\\:") if role else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and each value's start with the end of all."""
    a = pa.concat_arrays([a.cast(pa.large_string())])
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8), at


def assemble(columns: list[pa.Array | bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows of segments joined into one buffer: the bytes, each row's start, and each column's starts in it.

    A column is a string array, or bytes that are the same in every row.
    """
    n = next(len(c) for c in columns if isinstance(c, pa.Array))
    parts = [_buffers(c) if isinstance(c, pa.Array) else c for c in columns]
    lengths = np.stack([np.diff(p[1]) if isinstance(p, tuple) else np.full(n, len(p), np.int64) for p in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, p in enumerate(parts):
        to, size = starts[:, k], lengths[:, k]
        if isinstance(p, tuple):
            data, at = p
            source = data[at[0] : at[-1]]
            index = np.arange(len(source)) + np.repeat(to - (at[:-1] - at[0]), size)
            out[index] = source
        else:
            out[(to[:, None] + np.arange(len(p))).ravel()] = np.tile(np.frombuffer(p, np.uint8), n)
    return out, np.append(starts[:, 0], len(out)), list(starts.T)


def _blocks(rows: pa.Table, block: int) -> tuple[pa.RecordBatch, int]:
    ids = rows["conv_id"].combine_chunks()
    roles, texts = (pc.fill_null(rows[c].combine_chunks(), "") for c in ("role", "text"))
    body = escape(texts)
    out, row_at, starts = assemble([OPEN.encode(), escape(roles, role=True), b": ", body, CLOSE.encode()])
    known, values = ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy(False)
    first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (known[1:] != known[:-1])]))
    last = np.append(first[1:], len(ids))
    cuts = row_at[np.append(first, len(ids))]
    # masks count code points, as texts in rows do
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    trained = pc.equal(roles, TRAINED).to_numpy(False)
    spans = [[], []]
    for a, b in zip(first, last, strict=True):
        mine = np.flatnonzero(trained[a:b]) + a
        base = points[row_at[a]]
        spans[0].append(points[starts[3][mine]] - base)
        spans[1].append(points[starts[4][mine]] - base)
    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in s])]), pa.int32()), pa.array(np.concatenate(s), pa.int32())) for s in spans]
    text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    keys = ids.take(pa.array(first))
    return pa.RecordBatch.from_arrays([keys, pa.array(np.arange(block, block + len(first))), text, pa.array(last - first, pa.int32()), *lists], schema=_KIND), block + len(first)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(False)
        group = (np.cumsum(sizes) // BLOCK_BYTES).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                out, block = _blocks(pa.Table.from_batches([batch.slice(a, b - a)]), block)
                yield out


def format_chats(conversations: DataFrame) -> DataFrame:
    """Blocks of formatted conversations: conv_id, block (its order), formatted, turns, and the loss mask's spans.

    Turns are in the order of turn, then role, then text, nulls first. Null roles and texts count as empty; rows with a
    null conv_id are one conversation; repeated rows stay. Other columns are ignored; an empty table gives no blocks.
    Texts that are formatted are masked as a whole, so blocks are cut between turns only.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_stream, BLOCKS)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_NEW = object()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = READ.replace("bigint", "").replace("string", "").replace(",", " ").split()
    at, state, done = _NEW, None, []

    def close() -> None:
        if at is not _NEW:
            done.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return out

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_id"] != at:
                close()
                at, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["formatted"]
            place = 0
            while place < len(text):
                role = _ROLE.match(text, place)
                # inside a text a backslash stands before every </turn>, so the first one after a space closes it
                end = text.find(CLOSE, role.end()) if role else -1
                if end < 0:
                    raise ValueError("a formatted conversation can't be read back")
                state[0] += 1
                state[1].update(f"{unescape(role[1])}\n{unescape(text[role.end():end])}\n".encode())
                place = end + len(CLOSE)
            for a, b in zip(row["loss_start"], row["loss_end"], strict=True):
                plain = unescape(text[a:b])
                state[2] += len(plain)
                state[3].update(plain.encode())
            state[4] += len(text)
        if len(done) >= 1000:
            yield flush()
    close()
    if done:
        yield flush()


def read_back(blocks: DataFrame) -> DataFrame:
    """Digests of each conversation as read from the blocks that format_chats() has just made, in their order.

    SHA-256 is a chain over the whole conversation, so its blocks pass through one task, a block at a time.
    """
    return blocks.mapInArrow(_read, READ)
