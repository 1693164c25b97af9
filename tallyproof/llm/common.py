"""Helpers shared by the operators: Arrow text as flat byte arrays, words and their hashes, stored tables.

Texts are handled a slice at a time: the bytes of all texts of a slice lie in one array, and words, hashes and
n-grams of all of them are computed together. A slice ends at about ``SLICE_BYTES``; a longer text is a slice of
its own, so texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.session import written

SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
U64 = np.uint64

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after LOWER), and of [^\x20\x09-\x0D]+.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False

_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2**64; kept, as slices have about one length."""
    name = str(base)
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        out = np.full(size, base, dtype=U64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = out
        return out[:n]
    return have[:n]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span: equal bytes give equal hashes, wherever they lie."""
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    back = _power(_BACK, len(data) + 1)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(U64))


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column, and where each text starts in them (one entry more than rows).

    Nulls have no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes together."""
    if not batch.num_rows:
        return
    _, at = texts_of(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = max(first + 1, min(last, batch.num_rows))
        yield batch.slice(first, last - first)
        first = last


def words_of(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each text's words start (one entry more than texts).

    data: bytes of all texts; inside: which byte values belong to a word. A word never reaches over two texts.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(at), dtype=np.int64)
    is_in = inside[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = is_in[:-1]
    firsts = at[:-1][at[:-1] < len(data)]
    before[firsts] = False
    start = np.flatnonzero(is_in & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = is_in[1:]
    lasts = at[1:][at[1:] > 0] - 1
    after[lasts] = False
    end = np.flatnonzero(is_in & ~after) + 1
    return start, end, np.searchsorted(start, at)


def hashed_words(column: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column in order (A-Z lower-cased), and where each text's words start."""
    raw, at = texts_of(column)
    data = LOWER[raw]
    start, end, bounds = words_of(data, at, inside)
    return hash_spans(data, start, end), bounds


def runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] values), then start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def list_array(values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def new_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column (in any case) bears it."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return written(df, name)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package wherever they start. A cluster is given it with --py-files.

    Batches that Spark hands to Python end at ``BATCH_BYTES`` (rows are never cut), unless the session asks for less: texts of
    10,000 rows would lie in memory several times over on both sides.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    limit = spark.conf.get(BATCH_LIMIT, None)
    if limit is None or not limit.rstrip("b").isdigit() or not 0 < int(limit.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, f"{BATCH_BYTES}b")


def id_text(column: str = "doc_id") -> str:
    return f"crc32(encode(cast({column} as string), 'UTF-8'))"


def forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of the pairs (i, j) of nodes; which pairs joined two trees. root: arange of all nodes, changed in place."""
    used = np.zeros(len(i), dtype=bool)
    while True:
        a, b = root[i], root[j]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return used
        high, low = np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_])
        _, one = np.unique(high, return_index=True)
        used[open_[one]] = True
        root[high[one]] = low[one]
        while True:  # labels point to roots again
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b: long): one row (node, component) for each node that is not the smallest
    of its component. Links with null or of a node with itself say nothing.

    Alternates large-star and small-star steps, each a groupBy with partial sums, until nothing changes; the number of
    rounds grows with the logarithm of the longest chain. Nothing is collected but three sums per round. Hubs are no
    problem: a step needs only the smallest neighbour of a node, which is aggregated before the shuffle, and rows are
    joined back to it with skew handling left to Spark.
    """
    edges = stored(links.selectExpr("cast(greatest(a, b) as long) a", "cast(least(a, b) as long) b")
                   .where("a is not null and b is not null and a != b").distinct(), "links")
    last = None
    while True:
        # large-star: the larger neighbours of a node are linked to its smallest neighbour
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").selectExpr("b as a", "m as b").where("a != b").distinct()
        # small-star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b as a", "m as b").unionByName(least.selectExpr("a", "m as b"))
        edges = stored(small.where("a != b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.expr("cast(b as decimal(38,0))")),
                        F.sum(F.expr("cast(xxhash64(a, b) as decimal(38,0))"))).first()
        if last == tuple(now):
            return edges.selectExpr("a as node", "b as component")
        last = tuple(now)
