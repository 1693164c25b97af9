"""Repeated passages by sparse suffix arrays.

Of all word suffixes only those are retained that start at a minimiser: the smallest hash of ``GRAM`` words within some
window of ``min_words`` words. A passage that repeats holds the same minimisers wherever it lies, so two things are
sorted instead of all suffixes: first the retained suffixes by their first ``GRAM`` words, where neighbours that agree
survive; then, for those, every extension to the left by l and to the right by min_words - l words that has this
minimiser, where again neighbours in sorted order are compared. All that agree are repeats, and together they make
up the passages in their full length. Sorting is split by ranges of hashes; see ``exchange`` for what keeps hot passages small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyproof.llm.common import LOWER, SPACED, U64, hash_spans, mix, texts_of, words_of
from tallyproof.llm.exchange import answers, by_slice, from_blob, gather, parts_for, store_slices

MIN_WORDS = 50
GRAM = 25
_ODD = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Words:
    """The words of a slice: hashes, bytes, and the hash of any run of words."""

    def __init__(self, batch: pa.RecordBatch, text: str):
        self.raw, self.at = texts_of(batch.column(batch.schema.get_field_index(text)))
        data = LOWER[self.raw]
        self.start, self.end, self.bounds = words_of(data, self.at, SPACED)
        self.hash = hash_spans(data, self.start, self.end)
        n = len(self.hash)
        power = np.full(n + 1, _ODD)
        back = np.full(n + 1, _BACK)
        power[0] = back[0] = 1
        self.total = np.zeros(n + 1, dtype=U64)
        np.cumsum(self.hash * np.multiply.accumulate(power)[:n], out=self.total[1:])
        self.back = np.multiply.accumulate(back)
        self.text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        self.left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(n)

    def run(self, first: np.ndarray, size: int) -> np.ndarray:
        return mix((self.total[first + size] - self.total[first]) * self.back[first] + U64(size))


def minimisers(words: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``size`` words within a text, and the place of the smallest ``gram`` in each (the first of equals)."""
    starts = np.flatnonzero(words.left >= size)
    if not len(starts):
        return starts, starts
    n = len(words.hash)
    h = np.full(n, np.iinfo(np.uint64).max, dtype=U64)
    ok = np.flatnonzero(words.left >= gram)
    h[ok] = words.run(ok, gram)
    bits = U64(max(1, n.bit_length()))
    low = ((h >> bits) << bits) | np.arange(n, dtype=U64)  # upper bits of the hash, then the place
    span, width = size - gram + 1, 1
    while width * 2 <= span:  # minima of ever wider ranges
        low[: n - width] = np.minimum(low[: n - width], low[width:])
        width *= 2
    if width < span:
        low[: n - (span - width)] = np.minimum(low[: n - (span - width)], low[span - width:])
    return starts, (low[starts] & ((U64(1) << bits) - U64(1))).astype(np.int64)


def _anchors(batch: pa.RecordBatch, text: str, size: int, gram: int):
    words = Words(batch, text)
    starts, place = minimisers(words, size, gram)
    keys, inverse, count = np.unique(words.run(place, gram), return_inverse=True, return_counts=True)
    return words, starts, place, keys, inverse.reshape(-1)


def _windows(batch: pa.RecordBatch, ids: np.ndarray, text: str, size: int, gram: int, flags: list, parts: int):
    """Runs of ``size`` words whose minimiser repeats: their starts, distinct hashes, the hash of each, how often and where first."""
    words, starts, _, keys, inverse = _anchors(batch, text, size, gram)
    flag = gather(keys, flags, parts, np.uint8)
    starts = starts[flag[inverse] > 0]
    keys, inverse, count = np.unique(words.run(starts, size), return_inverse=True, return_counts=True)
    inverse = inverse.reshape(-1)
    order = np.lexsort((starts, ids[words.text[starts]], inverse))
    first = order[np.searchsorted(inverse[order], np.arange(len(keys)))]
    return words, starts, keys, inverse, count, first


def _ids(batch: pa.RecordBatch, id_col: str) -> np.ndarray:
    """Document ids as whole numbers; null comes last."""
    column = batch.column(batch.schema.get_field_index(id_col))
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()


SPANS = T.ArrayType(T.LongType())
REPEATS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", SPANS), T.StructField("ends", SPANS),
                        T.StructField("extra_starts", SPANS), T.StructField("extra_ends", SPANS)])


def _spans(words: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of hit words within texts: text, first word, end (both counted within the text)."""
    edge = np.zeros(len(hit) + 1, dtype=bool)
    edge[words.bounds] = True
    before, after = np.zeros(len(hit), dtype=bool), np.zeros(len(hit), dtype=bool)
    before[1:], after[:-1] = hit[:-1], hit[1:]
    a = np.flatnonzero(hit & (~before | edge[:-1]))
    b = np.flatnonzero(hit & (~after | edge[1:])) + 1
    text = words.text[a]
    return text, a - words.bounds[text], b - words.bounds[text]


def _covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + size, -1)
    return np.cumsum(delta[:-1]) > 0


def _solve(docs: DataFrame, id_col: str, text: str, size: int, gram: int) -> tuple[DataFrame, int]:
    """(batch, blob, flags, replies): slices of ``docs`` with the answers about their suffixes and passages."""
    parts_at = store_slices(docs, text)
    parts = parts_for(parts_at)

    def suffixes(batch: pa.RecordBatch, name: int, _: list) -> list[np.ndarray]:
        _, _, place, keys, inverse = _anchors(batch, text, size, gram)
        # a suffix counts once, however many windows it is the minimiser of
        own = np.unique(np.stack([inverse, place]), axis=1)[0] if len(place) else inverse
        return [keys, np.minimum(np.bincount(own, minlength=len(keys)), 255).astype(np.uint8)]

    def repeated(values: list[np.ndarray], _: np.ndarray) -> tuple[np.ndarray, int]:
        _, inverse = np.unique(values[0], return_inverse=True)
        return (np.bincount(inverse, weights=values[1])[inverse] > 1).astype(np.uint8), 0

    flags = by_slice(answers(parts_at, suffixes, repeated, parts), "flags")
    rows = parts_at.join(flags, "batch", "left")

    def passages(batch: pa.RecordBatch, name: int, earlier: list) -> list[np.ndarray]:
        ids = _ids(batch, id_col)
        words, starts, keys, _, count, first = _windows(batch, ids, text, size, gram, earlier[0], parts)
        return [keys, np.minimum(count, 2).astype(np.uint8), ids[words.text[starts[first]]]]

    def first_of(values: list[np.ndarray], name: np.ndarray) -> tuple[np.ndarray, int]:
        keys, count, ids = values
        _, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=count)
        order = np.lexsort((name, ids, inverse))
        lead = np.zeros(len(keys), dtype=bool)
        lead[order[np.searchsorted(inverse[order], np.arange(len(total)))]] = True
        return (total[inverse] > 1).astype(np.uint8) + 2 * lead.astype(np.uint8), 0

    found = by_slice(answers(rows, passages, first_of, parts), "replies")
    return rows.join(found, "batch", "left"), parts


def _mark(batch: pa.RecordBatch, flags: list, replies: list, parts: int, id_col: str, text: str, size: int, gram: int):
    """Words of a slice, which of them repeat, and which of those are not their passage's first occurrence."""
    words, starts, keys, inverse, _, first = _windows(batch, _ids(batch, id_col), text, size, gram, flags, parts)
    said = gather(keys, replies, parts, np.uint8)
    repeats = (said[inverse] & 1) > 0
    lead = np.zeros(len(starts), dtype=bool)
    lead[first[said >= 2]] = True
    n = len(words.hash)
    return words, _covered(n, starts[repeats], size), _covered(n, starts[repeats & ~lead], size)


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """One row per document that holds a passage of at least ``min_words`` words which occurs once more, there or elsewhere.

    Columns: doc_id, n_words, and lists of word spans (half-open, from 0): starts/ends of all repeated words,
    extra_starts/extra_ends of those that lie in a repeated run of ``min_words`` words other than its first occurrence
    (smallest doc_id, then first place; rows without id come last). Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, compared
    by 64-bit hashes. Null and short texts repeat nothing. Rows that share an id are separate texts. Other columns are not read.
    """
    rows, parts = _solve(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", min_words, gram)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece = from_blob(batch.column(1)[i].as_buffer())
                words, every, extra = _mark(piece, batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), parts, "doc_id", "text", min_words, gram)
                lists = []
                for hit in (every, extra):
                    of, a, b = _spans(words, hit)
                    at = pa.array(np.searchsorted(of, np.arange(piece.num_rows + 1)).astype(np.int32))
                    lists += [pa.ListArray.from_arrays(at, pa.array(a)), pa.ListArray.from_arrays(at, pa.array(b))]
                out = pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(np.diff(words.bounds)), *lists], names=["doc_id", *REPEATS.names])
                yield out.filter(pa.array([len(x) > 0 for x in lists[0]]))

    return rows.select("batch", "blob", "flags", "replies").mapInArrow(report, T.StructType([T.StructField("doc_id", T.LongType()), *REPEATS.fields]))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` without the extra occurrences of repeated passages: their words, with the white space behind them, are cut out.

    All columns and rows stay, but for texts that had words and are left without any. Texts without extra words are unchanged.
    """
    rows, parts = _solve(docs, id_col, text, min_words, gram)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece = from_blob(batch.column(1)[i].as_buffer())
                words, _, extra = _mark(piece, batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), parts, id_col, text, min_words, gram)
                of, a, b = _spans(words, extra)
                where = piece.schema.get_field_index(text)
                changed, keep = piece.column(where).to_pylist(), np.ones(piece.num_rows, dtype=bool)
                data = words.raw.tobytes()
                for k in np.unique(of).tolist():
                    low, high, out = int(words.at[k]), int(words.at[k + 1]), []
                    base, last = int(words.bounds[k]), int(words.bounds[k + 1])
                    for x, y in zip((a[of == k] + base).tolist(), (b[of == k] + base).tolist(), strict=True):
                        out.append(data[low: int(words.start[x])])
                        low = int(words.start[y]) if y < last else high
                    changed[k] = b"".join([*out, data[low:high]]).decode()
                    keep[k] = bool((~extra[base:last]).any())
                columns = list(piece.columns)
                columns[where] = pa.array(changed, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names).filter(pa.array(keep))

    return rows.select("batch", "blob", "flags", "replies").mapInArrow(cut, schema)


def repeats_digest(docs: DataFrame) -> DataFrame:
    """One row per document with a repeated passage: doc_id, n_words, n_repeated, n_extra, n_passages, first_word, last_word."""
    total = "aggregate(zip_with({1}, {0}, (b, a) -> b - a), 0L, (x, y) -> x + y)"
    return repeated_passages(docs).selectExpr(
        "doc_id", "n_words", f"{total.format('starts', 'ends')} as n_repeated", f"{total.format('extra_starts', 'extra_ends')} as n_extra",
        "cast(size(starts) as long) as n_passages", "starts[0] as first_word", "ends[size(ends) - 1] - 1 as last_word",
        "array_join(transform(arrays_zip(starts, ends), s -> concat(s.starts, '-', s.ends)), ',') as passages")
