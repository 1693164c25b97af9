"""Spelling variants by dense prefix-suffix tiling: words that differ by one inserted, deleted or replaced code point.

A position of the longer of two words, by pieces of ``PIECE`` code points, is where they first differ. So both agree in all that
stands before and behind that piece, and a word is put into one group for each piece of its own length, and for each piece of the length
one above: a group is a length, a piece and what stands around it. A group's words differ within ``PIECE`` code points only; with a
alphabet of a letters there are at most a**2 + a of them, however common a prefix or suffix is. Groups of one word are dropped by
their hashes alone; only the words of the rest are looked up.

Within a task the words of its groups lie in padded matrices of code points, once aligned to the left and once to the right. Blocks of
rows are compared with the blocks d rows further on, for d = 1, 2, ... until no group is that long. Common prefix plus common suffix
reaching the longer length minus one is a single edit. A pair counts in the piece of its first difference, so exactly once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import U64, hash_spans, mix, runs, slices, stored, texts_of

PIECE = 2
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: How many times as frequent a form is as its variant.
TIMES = 10
#: One run in so many, by crc32 of document and run, loses a code point.
DROPPED = 31
#: Code points of words that a task compares, and those in one matrix.
TASK_POINTS = 4 << 20
TILE_POINTS = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of all texts and how often they occur.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; where 31 divides the crc32 h of
    "<doc_id>:<run>", without the code point at h modulo the run's length. Shorter and rarer ones are left out. A null text has no words; a
    null id reads as no characters. Rows that share an id are rows of their own.
    """
    found = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"))
    hashed = found.select("d", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.encode(F.concat("d", F.lit(":"), "run"), "UTF-8")))
    word = F.expr(f"if(h % {DROPPED} = 0, concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2)), run)")
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, the byte at which each code point starts (and the end), and the first code point of each word (and the end)."""
    data, at = texts_of(column)
    point = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return data, point, np.searchsorted(point, at)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) -> the groups of each word: key, longer length, piece, id."""
    for batch in batches:
        for part in slices(batch, "word", 1 << 18):
            data, point, first = _spans(part.column(1))
            length, ids = np.diff(first), part.column(0).to_numpy()
            size = np.concatenate([length, length + 1])
            row = np.tile(np.arange(len(length)), 2)
            n = -(-size // PIECE)
            piece, row, size = runs(np.zeros(len(n), dtype=np.int64), n), np.repeat(row, n), np.repeat(size, n)
            behind = size - np.minimum((piece + 1) * PIECE, size)
            start, end = first[row], first[row + 1]
            before = hash_spans(data, point[start], point[start + piece * PIECE])
            after = hash_spans(data, point[end - behind], point[end])
            key = mix(before * U64(0x9E3779B97F4A7C15) + mix(after + mix((size * 65536 + piece).astype(U64)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(size.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(ids[row])], names=["key", "size", "piece", "id"])


def _common(points: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, step: int) -> np.ndarray:
    """Equal code points from places a and b on, to the right (step 1) or the left (-1), of at most ``least``."""
    column = np.arange(int(least.max()) if len(least) else 0)
    inside = column < least[:, None]
    at = np.where(inside, column * step, 0)
    equal = np.zeros((len(least), len(column) + 1), dtype=bool)
    equal[:, :-1] = inside & (points[a[:, None] + at] == points[b[:, None] + at])
    return equal.argmin(axis=1)


def single_edits(points: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of words, first[a]:first[a + 1] of the code points and so on: is it one edit, and where do they first differ.

    Equal words are none. The pairs are taken in tiles of about ``TILE_POINTS`` code points.
    """
    near, place = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=np.int64)
    length = np.diff(first)
    longer, shorter = np.maximum(length[a], length[b]), np.minimum(length[a], length[b])
    at = 0
    while at < len(a):
        end = min(len(a), at + max(1, TILE_POINTS // int(longer[at] + 1)))
        end = min(end, at + max(1, TILE_POINTS // int(longer[at:end].max() + 1)))
        i, j, least = a[at:end], b[at:end], shorter[at:end]
        ahead = _common(points, first[i], first[j], least, 1)
        back = _common(points, first[i + 1] - 1, first[j + 1] - 1, least, -1)
        place[at:end] = ahead
        near[at:end] = (ahead + back >= longer[at:end] - 1) & (longer[at:end] - least <= 1) & (ahead < longer[at:end])
        at = end
    return near, place


def _compare(table: pa.Table) -> pa.Table:
    """The groups of a task: for each word of a group its near words in it, and the best of them (largest n, smallest word)."""
    key, size, piece = (table.column(x).to_numpy() for x in ("key", "size", "piece"))
    order = np.lexsort((piece, key, size))
    table = table.take(pa.array(order)).combine_chunks()
    key, size, piece = key[order], size[order], piece[order]
    word, n = table.column("word").combine_chunks(), table.column("n")
    rank = np.empty(len(order), dtype=np.int64)
    by_rank = pc.sort_indices(table, sort_keys=[("n", "descending"), ("word", "ascending")]).to_numpy()
    rank[by_rank] = np.arange(len(order))
    points = np.frombuffer("".join(word.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum(pc.utf8_length(word).to_numpy())]).astype(np.int64)
    length = np.diff(first)
    group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (piece[1:] != piece[:-1]))]).astype(np.int64)
    near, best = np.zeros(len(order), dtype=np.int64), np.full(len(order), len(order), dtype=np.int64)
    active, d = np.arange(len(order)), 0
    while len(active):
        d += 1
        active = active[active + d < len(order)]
        active = active[group[active] == group[active + d]]
        a = active[np.maximum(length[active], length[active + d]) == size[active]]
        found, place = single_edits(points, first, a, a + d)
        a = a[found & (place // PIECE == piece[a])]
        # within one step a row is the first of one pair and the second of one pair at most
        near[a] += 1
        near[a + d] += 1
        best[a] = np.minimum(best[a], rank[a + d])
        best[a + d] = np.minimum(best[a + d], rank[a])
    some = np.flatnonzero(near)
    top = pa.array(by_rank[best[some]])
    return pa.table({"id": table.column("id").take(pa.array(some)), "n_near": near[some], "top_n": n.take(top), "top": word.take(top)})


def variants(words: DataFrame, *, times: int = TIMES) -> DataFrame:
    """One row per row of ``words`` (word, n; each word once): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. form is the near word of the largest n (ties: the smallest in
    code-point order) if that is at least ``times`` n, else null; root is where forms lead from the word on, itself without one.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")).withColumn("id", F.monotonically_increasing_id()), "words")
    keys = words.select("id", "word").mapInArrow(_keys, "key long, size int, piece int, id long")
    shared = stored(keys.select("*", F.expr("count(*) over (partition by key)").alias("members")).where("members > 1").drop("members"), "groups")
    points = shared.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    tasks = max(1, points // TASK_POINTS)
    dealt = shared.join(words, "id").withColumn("part", F.expr(f"pmod(key, {tasks})"))
    found = dealt.groupBy("part").applyInArrow(lambda table: _compare(table), "id long, n_near long, top_n long, top string")
    best = found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("top_n")).alias("less"), "top")).alias("best"))
    formed = stored(words.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr(f"if(-best.less >= {times} * n, best.top, null)").alias("form"), F.expr(f"if(-best.less >= {times} * n, -best.less, null)").alias("form_n")), "forms")
    # n grows at each step, at least ``times``-fold, so the longest way is known; each round doubles the part of it that is walked
    most = formed.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(most) / math.log(times)) + 1 if times > 1 else None
    up, walked, before = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots"), 1, None
    while steps is None or walked < steps:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stored(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        walked *= 2
        if steps is None:
            now = up.agg(F.sum(F.expr("cast(xxhash64(word, root) as decimal(38,0))"))).first()[0]
            if now == before:
                break
            before = now
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text): those of 7 code points and more that occur twice or more."""
    return variants(word_counts(docs))
