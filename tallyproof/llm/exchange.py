"""Slices of a table and global answers about the 64-bit keys found in them.

A slice is a run of rows with about 2 MB of text, kept as one compressed binary value, so that later passes see the
same rows together. Each slice asks about its distinct keys (n-grams, passages): for each of ``parts`` ranges of keys it
sends one message with all its keys there. All messages of a part meet in one group, which judges the keys and replies
to each message. What a hot key costs is one entry per slice, not one per occurrence, and a group holds the distinct
keys of about ``SLICES_PER_PART`` slices' worth, whatever the size of the table.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import SLICE_BYTES, mix, slices, stored

SLICES_PER_PART = 8
LEAST_PARTS = 16


def pack(values: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values, protocol=5))


def unpack(data: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def pack_message(values: list[np.ndarray]) -> bytes:
    """As ``pack``, for ascending keys first: their differences are stored byte plane by byte plane, so the high ones vanish."""
    steps = np.diff(values[0], prepend=np.uint64(0))
    return pack([np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), *values[1:]])


def unpack_message(data: bytes) -> list[np.ndarray]:
    planes, *rest = unpack(data)
    return [np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64), *rest]


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(data: pa.Buffer | bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def store_slices(df: DataFrame, text: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Stored (batch long, blob binary): all rows of ``df`` in slices, with all their columns."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([to_blob(piece)], pa.binary())], names=["batch", "blob"])
                seq += 1

    return stored(df.mapInArrow(cut, "batch long, blob binary"), "slices")


def parts_for(slices_: DataFrame, slices_per_part: int = SLICES_PER_PART) -> int:
    return max(LEAST_PARTS, slices_.count() // slices_per_part)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


Make = Callable[[pa.RecordBatch, int, list], list[np.ndarray]]
Judge = Callable[[list[np.ndarray], np.ndarray], tuple[np.ndarray, int]]


def answers(rows: DataFrame, make: Make, judge: Judge, parts: int) -> DataFrame:
    """(batch, p, reply, note): what ``judge`` says about the keys of each slice, and about each part as a whole.

    rows: (batch, blob) and any columns of earlier replies. ``make(slice, batch, replies)`` gives [keys, ...]: the distinct keys
    of a slice in ascending order and arrays beside them. ``judge([keys, ...], batch)`` gets those of all messages of a
    part, laid end to end, with the slice each entry is from, and gives one value for each entry and a number for the part.
    ``by_slice`` brings the replies of a slice together.
    """
    earlier = rows.columns[2:]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                values = make(from_blob(batch.column(1)[i].as_buffer()), name, [batch.column(k + 2)[i].as_py() for k in range(len(earlier))])
                part = part_of(values[0], parts)
                order = np.argsort(part, kind="stable")
                used, at = np.unique(part[order], return_index=True)
                ends = np.append(at[1:], len(order))[: len(at)]
                out = [pack_message([x[order[a:b]] for x in values]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), name)), pa.array(out, pa.binary())], names=["p", "batch", "message"])

    def reply(table: pa.Table) -> pa.Table:
        messages = [unpack_message(x) for x in table.column("message").to_pylist()]
        sizes = [len(m[0]) for m in messages]
        name = np.repeat(table.column("batch").to_numpy(), sizes)
        said, note = judge([np.concatenate(x) for x in zip(*messages, strict=True)], name)
        ends = np.cumsum(sizes)
        out = [pack([said[b - n: b]]) for n, b in zip(sizes, ends.tolist(), strict=True)]
        return pa.table({"batch": table.column("batch"), "p": table.column("p"), "reply": pa.array(out, pa.binary()),
                         "note": pa.array(np.full(len(out), note, dtype=np.int64))})

    sent = rows.mapInArrow(send, "p int, batch long, message binary")
    return sent.groupBy("p").applyInArrow(reply, "batch long, p int, reply binary, note long")


def by_slice(got: DataFrame, name: str) -> DataFrame:
    """(batch, name): the replies to each slice, one for each part at most."""
    return got.groupBy("batch").agg(F.collect_list(F.struct("p", "reply")).alias(name))


def gather(keys: np.ndarray, replies: list, parts: int, dtype: type) -> np.ndarray:
    """The reply to each of a slice's distinct ascending keys."""
    part = part_of(keys, parts)
    out = np.zeros(len(keys), dtype=dtype)
    for r in replies or []:
        out[part == r["p"]] = unpack(r["reply"])[0]
    return out
