"""Packing of token sequences by linear grouping.

Which document goes where is settled on the histogram of piece lengths alone: at most ``capacity`` counts, whatever the
size of the corpus. Large lengths are sorted and cut into groups of equal cardinality and rounded up to the largest of
their group; the few sizes left make a cutting-stock problem whose configurations are found by column generation; the
actual lengths then take the places of the rounded ones, and what is small, or left by rounding the solution down to
whole numbers, is put best-fit into the gaps. The plan is a list of runs (how many sequences, which lengths in each).

Pieces find their place by their rank among the pieces of their length: a task numbers its own, and the counts of all
tasks before it are added. No piece is moved for that, and no group of pieces is ever collected.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyproof.llm.common import SLICE_BYTES, runs, slices, stored
from tallyproof.llm.tokens import default_path, encoder, ended

CAPACITY = 2048
GROUPS = 64
#: Lengths above this share of the capacity are large.
LARGE = 1 / 8

Run = tuple[int, tuple[int, ...]]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[float, np.ndarray]]:
    """Fractional solution of the cutting-stock problem: (how often, how many of each size in one sequence).

    Revised simplex with columns from a knapsack over the capacity.
    """
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        value = np.linalg.solve(basis, demand)
        dual = np.linalg.solve(basis.T, np.ones(n))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = sizes <= c
            gain = np.where(fits, best[c - np.minimum(sizes, c)] + dual, -1.0)
            k = int(gain.argmax())
            if gain[k] > best[c - 1] + 1e-12:
                best[c], pick[c] = gain[k], k
            else:
                best[c], pick[c] = best[c - 1], -1
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(n), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(sizes[pick[c]])
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(value, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return [(float(x), basis[:, j].astype(int)) for j, x in enumerate(np.linalg.solve(basis, demand)) if x > 1e-9]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Runs of sequences that hold ``counts[length]`` pieces of each length (1 to capacity), each piece once."""
    out: list[Run] = []
    if counts.get(capacity):
        out.append((counts[capacity], (capacity,)))
    large = [(x, counts[x]) for x in sorted(counts, reverse=True) if capacity * LARGE < x < capacity and counts[x]]
    rest = Counter({x: n for x, n in counts.items() if 0 < x <= capacity * LARGE})
    total = sum(n for _, n in large)
    open_: list[Run] = []
    if total:
        each = -(-total // min(groups, len(large)))
        # groups of equal cardinality, from the largest lengths down; a length may lie in two
        group: list[list[list[int]]] = [[]]
        room = each
        for x, n in large:
            while n:
                if not room:
                    group.append([])
                    room = each
                take = min(n, room)
                group[-1].append([x, take])
                room -= take
                n -= take
        by_size: dict[int, list[list[int]]] = {}
        for g in group:  # groups that begin with one length are one size
            by_size.setdefault(g[0][0], []).extend(g)
        sizes = np.array(sorted(by_size, reverse=True))
        demand = np.array([sum(n for _, n in by_size[int(s)]) for s in sizes], dtype=float)
        for often, column in sorted(configurations(sizes, demand, capacity), key=lambda y: -float(y[1] @ sizes)):
            left = [sum(n for _, n in by_size[int(s)]) for s in sizes]
            m = min([int(often + 1e-6), *(left[k] // int(a) for k, a in enumerate(column) if a)])
            if m:
                slots = [by_size[int(sizes[k])] for k, a in enumerate(column) for _ in range(a)]
                open_ += _substitute(slots, m)
        for g in by_size.values():
            for x, n in g:
                rest[x] += n
    return out + best_fit(open_, rest, capacity)


def _substitute(slots: list[list[list[int]]], m: int) -> list[Run]:
    """Take m pieces for each slot from its group; sequences with the same actual lengths are one run."""
    cuts, taken = {0, m}, []
    for source in slots:
        own, at = [], 0
        while at < m:
            x, n = source[0]
            take = min(n, m - at)
            own.append((at, x))
            at += take
            cuts.add(at)
            if take == n:
                source.pop(0)
            else:
                source[0][1] -= take
        taken.append(own)
    edges = sorted(cuts)
    found: list[Run] = []
    where = [0] * len(taken)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        lengths = []
        for k, own in enumerate(taken):
            while where[k] + 1 < len(own) and own[where[k] + 1][0] <= a:
                where[k] += 1
            lengths.append(own[where[k]][1])
        found.append((b - a, tuple(lengths)))
    return found


def best_fit(open_: list[Run], rest: dict[int, int], capacity: int) -> list[Run]:
    """Put the remaining lengths, largest first, each into the sequence with the least room that takes it."""
    by_room: dict[int, list[Run]] = defaultdict(list)
    for m, lengths in open_:
        by_room[capacity - sum(lengths)].append((m, lengths))
    rooms = sorted(by_room)
    for x in sorted(rest, reverse=True):
        n = rest[x]
        while n:
            k = bisect.bisect_left(rooms, x)
            if k < len(rooms):
                room = rooms[k]
                m, lengths = by_room[room].pop()
                take = min(m, n)
                if m > take:
                    by_room[room].append((m - take, lengths))
                fresh = (take, (*lengths, x))
            else:
                room, each = None, capacity // x
                take = n if n < each else n - n % each
                fresh = (1, (x,) * n) if n < each else (n // each, (x,) * each)
            left = capacity - sum(fresh[1])
            if left not in by_room or not by_room[left]:
                if left not in rooms:
                    bisect.insort(rooms, left)
            by_room[left].append(fresh)
            if room is not None and not by_room[room]:
                rooms.remove(room)
            n -= take
    return [run for room in sorted(by_room) for run in by_room[room]]


def places(found: list[Run], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan by rank: the pieces of ``length`` with rank from ``first`` on lie in sequences from ``sequence`` on, at
    ``offset``. Sorted by ``key`` = (length, first), packed into one number by ``place_of``."""
    rows, used, base = [], Counter(), 0
    for m, lengths in found:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], base, offset))
            used[x] += m
            offset += x
        base += m
    rows.sort()
    cells = np.array(rows, dtype=np.int64).reshape(-1, 4)
    at = np.searchsorted(cells[:, 0], np.arange(capacity + 2))
    return {"first": cells[:, 1], "sequence": cells[:, 2], "offset": cells[:, 3], "at": at}


def place_of(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank: binary search within the rows of a length, all at once."""
    lo, hi = table["at"][length].copy(), table["at"][length + 1].copy()
    while True:
        wide = np.flatnonzero(hi - lo > 1)
        if not len(wide):
            break
        mid = (lo[wide] + hi[wide]) >> 1
        ok = table["first"][mid] <= rank[wide]
        lo[wide] = np.where(ok, mid, lo[wide])
        hi[wide] = np.where(ok, hi[wide], mid)
    return table["sequence"][lo] + rank - table["first"][lo], table["offset"][lo]


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("chunk", T.IntegerType()), T.StructField("rank", T.LongType()),
])


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Encode each text, add ``end_id``, and cut what is longer than ``capacity`` so that only the first piece is shorter.

    One row per piece: doc_id, piece (from 0), start (ids of the document before it), length, ids (little-endian 32-bit),
    and, for ``pack``, the chunk (task) that made it and its rank among the pieces of its length there. Stored, so
    that chunks and ranks stay as they are. Null texts are empty (one piece with the end id); null and repeated doc_ids are kept.
    """
    path = path or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", 2 * SLICE_BYTES):
                ids, bounds = ended(*encoder(path).encode(part.column(1)), end_id)
                size = np.diff(bounds)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), count)
                piece = runs(np.zeros(len(size), dtype=np.int64), count)
                end = size[doc] - (count[doc] - 1 - piece) * capacity
                begin = np.maximum(end - capacity, 0)
                length = end - begin
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty(len(length), dtype=np.int64)
                rank[order] = np.arange(len(length)) - first + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                cuts = np.append(bounds[doc] + begin, len(ids)).astype(np.int32) * 4
                raw = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(begin), pa.array(length), raw,
                    pa.array(np.full(len(length), chunk, dtype=np.int32)), pa.array(rank)], names=PIECES.names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(encode, PIECES), "pieces")


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (with length, chunk and rank) with ``sequence_id`` and ``offset`` instead of chunk and rank.

    The driver gets one count per length. No pieces: no rows.
    """
    cells = stored(pieces.groupBy("chunk", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {int(r["length"]): int(r["n"]) for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = pieces.sparkSession.sparkContext.broadcast(places(plan(counts, capacity, groups), capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select(F.col("chunk"), F.col("length"), F.coalesce(before, F.lit(0)).alias("before"))
    rows = pieces.join(starts, ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("chunk", "before")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            sequence, offset = place_of(table.value, length, rank)
            keep = [i for i, x in enumerate(batch.schema.names) if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=schema.names)

    return rows.mapInArrow(settle, schema)


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS, **options) -> DataFrame:
    """One row per piece with its ids, its sequence and its offset there; sequences are filled without gaps from 0."""
    return pack(token_pieces(docs, capacity=capacity, **options), capacity=capacity, groups=groups)


def packing_digest(docs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "chunk", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
