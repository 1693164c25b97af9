"""Scores of texts by a bigram model held in Elias-Fano tries.

The first level of a trie holds the contexts in ascending order, the second the words that follow each of them, as one
monotone sequence in which a word is told relative to its context; pointers from the first to the second are monotone too.
All three are Elias-Fano coded, probabilities are one-byte codes. A trie is one flat buffer, so a file of it can be
mapped into memory. A bigram is found by successor search: the context in the first level, then the word among the
followers the pointers enclose.

The probabilities are smoothed by interpolation: P(w|v) = share * joint(v, w) / P(v) + (1 - share) * P(w), where joint is the
code's relative frequency and P(w) = (c + 0.1) / (N + 0.1 * (V + 1)); after a word that training never saw, P(w) alone. Tries are
made for ranges of hashes of bigrams, so no worker holds the whole model, and a hot context is spread over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import SLICE_BYTES, SPACED, U64, hashed_words, id_text, mix, stored
from tallyproof.llm.exchange import answers, by_slice, from_blob, gather, part_of, parts_for, store_slices

SHARE = 0.6
PRIOR = 0.1
#: Hashes of the end of a text and of what stands before its first word.
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: A code holds the logarithm of a count in steps of this size; code 1 is a count of 1, code 0 none.
STEP = 0.1
#: Bigrams that are looked up at once.
LOOKUPS = 1 << 16
_LOW32 = U64(0xFFFFFFFF)


def to_code(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(1 + np.rint(np.log(np.maximum(count, 1)) / STEP), 255), 0).astype(np.uint8)


def from_code(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp((code.astype(np.float64) - 1) * STEP), 0.0)


class EliasFano:
    """A monotone sequence of whole numbers: the low bits of each, and the high parts in unary."""

    def __init__(self, count: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.count, self.bits, self.low, self.high = count, bits, low, high
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2, dtype=U64)
        if bits and n:
            place = np.arange(n, dtype=U64) * U64(bits)
            part = values & ((U64(1) << U64(bits)) - U64(1))
            word, shift = (place >> U64(6)).astype(np.int64), place & U64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift + U64(bits) > U64(64))
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        at = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) if n else 0) // 64 + 1, dtype=U64)
        np.bitwise_or.at(high, at >> 6, U64(1) << (at & 63).astype(U64))
        return cls(n, bits, low, high)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """Values at the places ``index``."""
        index = np.asarray(index, dtype=np.int64)
        word = np.searchsorted(self.ones, index, side="right") - 1
        nth, bits, at = index - self.ones[word], self.high[word], np.zeros(len(index), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # the place of the nth one in a 64-bit word
            lower = np.bitwise_count(bits & ((U64(1) << U64(width)) - U64(1))).astype(np.int64)
            up = nth >= lower
            nth = np.where(up, nth - lower, nth)
            bits = np.where(up, bits >> U64(width), bits)
            at += np.where(up, width, 0)
        high = (word * 64 + at - index).astype(U64) << U64(self.bits)
        if not self.bits:
            return high
        place = index.astype(U64) * U64(self.bits)
        where, shift = (place >> U64(6)).astype(np.int64), place & U64(63)
        low = self.low[where] >> shift
        low |= np.where(shift > U64(0), self.low[where + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return high | (low & ((U64(1) << U64(self.bits)) - U64(1)))

    def successor(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each value: the first place in [first, last) that holds no smaller one (last if there is none)."""
        lo, hi = first.astype(np.int64).copy(), last.astype(np.int64).copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self[mid] < values[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.count, self.bits, len(self.low), len(self.high)], dtype=U64), self.low, self.high]

    @classmethod
    def read(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        count, bits, low, high = (int(x) for x in data[at: at + 4])
        at += 4
        return cls(count, bits, data[at: at + low], data[at + low: at + low + high]), at + low + high


class Trie:
    """Bigrams (context and word in 32 bits each) with one-byte codes."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, words: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.words, self.codes = contexts, pointers, words, codes

    @classmethod
    def build(cls, keys: np.ndarray, codes: np.ndarray) -> Trie:
        """keys: ascending distinct (context << 32 | word)."""
        context, at = np.unique(keys >> U64(32), return_index=True)
        which = np.repeat(np.arange(len(context), dtype=U64), np.diff(np.append(at, len(keys))))
        return cls(EliasFano.encode(context), EliasFano.encode(np.append(at, len(keys))), EliasFano.encode((which << U64(32)) | (keys & _LOW32)), codes.astype(np.uint8))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each bigram, 0 if it is not there. A context is looked up once for a run of its bigrams."""
        out = np.zeros(len(keys), dtype=np.uint8)
        for a in range(0, len(keys), LOOKUPS):
            out[a: a + LOOKUPS] = self._find(keys[a: a + LOOKUPS])
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.uint8)
        n = self.contexts.count
        if not n:
            return out
        context, of = np.unique(keys >> U64(32), return_inverse=True)
        at = self.contexts.successor(context, np.zeros(len(context)), np.full(len(context), n))
        there = at < n
        there[there] = self.contexts[at[there]] == context[there]
        hit = np.flatnonzero(there[of])
        at = at[of[hit]]
        first, last = self.pointers[at].astype(np.int64), self.pointers[at + 1].astype(np.int64)
        wanted = (at.astype(U64) << U64(32)) | (keys[hit] & _LOW32)
        place = self.words.successor(wanted, first, last)
        inside = np.flatnonzero(place < last)
        inside = inside[self.words[place[inside]] == wanted[inside]]
        out[hit[inside]] = self.codes[place[inside]]
        return out

    def to_bytes(self) -> bytes:
        codes = np.zeros(-(-len(self.codes) // 8) * 8, dtype=np.uint8)
        codes[: len(self.codes)] = self.codes
        return np.concatenate([*self.contexts.arrays(), *self.pointers.arrays(), *self.words.arrays(), np.array([len(self.codes)], dtype=U64), codes.view(U64)]).tobytes()

    @classmethod
    def from_buffer(cls, data: np.ndarray) -> Trie:
        """From 64-bit words in memory or in a mapped file; nothing is copied."""
        contexts, at = EliasFano.read(data, 0)
        pointers, at = EliasFano.read(data, at)
        words, at = EliasFano.read(data, at)
        return cls(contexts, pointers, words, data[at + 1:].view(np.uint8)[: int(data[at])])

    @classmethod
    def open(cls, path: str | Path) -> Trie:
        return cls.from_buffer(np.memmap(path, dtype=U64, mode="r"))


class Tokens:
    """Words of a slice with an end after each text, and which texts are learned from."""

    def __init__(self, batch: pa.RecordBatch):
        words, bounds = hashed_words(batch.column(2), SPACED)
        n = len(bounds) - 1
        self.bounds = bounds + np.arange(n + 1)
        self.word = np.full(len(words) + n, END, dtype=U64)
        inside = np.ones(len(self.word), dtype=bool)
        inside[self.bounds[1:] - 1] = False
        self.word[inside] = words
        self.text = np.repeat(np.arange(n), np.diff(self.bounds))
        self.before = np.empty(len(self.word), dtype=U64)
        self.before[1:] = self.word[:-1]
        self.before[self.bounds[:-1]] = BEGIN
        self.learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[self.text]
        self.n = n

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words (and the begin mark) ascending; training count of each in the slice; the place of each token."""
        keys, inverse = np.unique(np.append(self.word, BEGIN), return_inverse=True)
        count = np.bincount(inverse[:-1], weights=self.learn, minlength=len(keys)).astype(np.int64)
        return keys, count, inverse[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = (mix(self.before) & (_LOW32 << U64(32))) | (mix(self.word) & _LOW32)
        keys, inverse = np.unique(own, return_inverse=True)
        return keys, np.bincount(inverse, weights=self.learn, minlength=len(keys)).astype(np.int64), inverse


def _narrow(count: np.ndarray) -> np.ndarray:
    return count.astype(np.min_scalar_type(int(count.max(initial=0))))


def word_counts(values: list[np.ndarray], _: np.ndarray) -> tuple[np.ndarray, int]:
    """Training count of each entry's word, and how many distinct words were seen in training."""
    keys, inverse = np.unique(values[0], return_inverse=True)
    total = np.bincount(inverse, weights=values[1].astype(np.float64), minlength=len(keys)).astype(np.int64)
    return _narrow(total[inverse]), int((total > 0).sum())


def build_part(keys: np.ndarray, counts: np.ndarray) -> Trie:
    """The trie of a part: distinct ascending bigrams with their training counts; those without any are left out."""
    seen = counts > 0
    return Trie.build(keys[seen], to_code(counts[seen]))


def pair_codes(values: list[np.ndarray], _: np.ndarray) -> tuple[np.ndarray, int]:
    keys, inverse = np.unique(values[0], return_inverse=True)
    data = build_part(keys, np.bincount(inverse, weights=values[1], minlength=len(keys))).to_bytes()
    trie = Trie.from_buffer(np.frombuffer(data, dtype=U64))
    return trie.find(keys)[inverse], len(trie.codes)


def _rows(docs: DataFrame, id_col: str, text: str, learn: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(f"coalesce({learn}, false)").alias("learn"), F.col(text).alias("text"))


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", learn: str | None = None, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, learned_from, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which the SQL condition ``learn`` holds (default: crc32(doc_id) mod 10 is not 0; null is no) and scores all.
    Tokens are the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one end; a null text is empty. base_score sums
    log10((c + 0.1) / (N + 0.1 * (V + 1))) over tokens, score is the log10 probability of the text under the model. With nothing to
    learn from, N and V are 0 and all tokens have probability 1. Repeated rows count as often as they occur; null ids are not learned
    from by default. Words are compared by 64-bit hashes, the parts of a bigram by 32 bits each. Empty table: no rows.
    """
    slices_ = store_slices(_rows(docs, id_col, text, learn or f"{id_text(id_col)} % 10 != 0"), "text", 2 * SLICE_BYTES)
    parts = parts_for(slices_, 2)

    def ask_words(batch: pa.RecordBatch, name: int, _: list) -> list[np.ndarray]:
        keys, count, _ = Tokens(batch).words()
        return [keys, _narrow(count)]

    counted = stored(answers(slices_, ask_words, word_counts, parts), "word_counts")
    vocabulary = counted.groupBy("p").agg(F.max("note").alias("v")).agg(F.sum("v")).first()[0] or 0
    words = by_slice(counted, "words")

    def begun(tokens: Tokens) -> int:
        return int((tokens.learn[tokens.bounds[:-1]]).sum())

    def ask_pairs(batch: pa.RecordBatch, name: int, _: list) -> list[np.ndarray]:
        keys, count, _ = Tokens(batch).pairs()
        return [keys, _narrow(count)]

    coded = by_slice(answers(slices_, ask_pairs, pair_codes, parts), "pairs")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = Tokens(from_blob(batch.column(1)[i].as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array([int(tokens.learn.sum())], pa.int64()), pa.array([begun(tokens)], pa.int64())], names=["n", "texts"])

    total = slices_.mapInArrow(sizes, "n long, texts long").agg(F.sum("n"), F.sum("texts")).first()
    n_train, n_texts = int(total[0] or 0), int(total[1] or 0)
    floor = np.log10(n_train + PRIOR * (vocabulary + 1)) if n_train else np.log10(PRIOR)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece = from_blob(batch.column(1)[i].as_buffer())
                tokens = Tokens(piece)
                keys, _, of = tokens.words()
                count = gather(keys, batch.column(2)[i].as_py(), parts, np.int64).astype(np.float64)
                count[np.searchsorted(keys, BEGIN)] = n_texts
                known = count[of]
                single = np.log10(known + PRIOR) - floor
                pair_keys, _, pair_of = tokens.pairs()
                joint = from_code(gather(pair_keys, batch.column(3)[i].as_py(), parts, np.uint8))[pair_of]
                context = count[np.searchsorted(keys, tokens.before)]
                back = 10.0 ** single
                chance = np.where(context > 0, share * np.minimum(joint / np.maximum(context, 1), 1) + (1 - share) * back, back)
                sums = [np.bincount(tokens.text, weights=x, minlength=tokens.n) for x in (known > 0, single, np.log10(chance))]
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), piece.column(1), pa.array(np.diff(tokens.bounds)), pa.array(sums[0].astype(np.int64)),
                    pa.array(np.full(tokens.n, n_train, dtype=np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                ], names=["doc_id", "learned_from", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = slices_.join(words, "batch").join(coded, "batch").select("batch", "blob", "words", "pairs")
    return rows.mapInArrow(finish, "doc_id long, learned_from boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", learn: str = "true") -> DataFrame:
    """The bigram model of a corpus as tries: (p, bigrams, trie binary), one for each range of hashes, for other programs to map."""
    slices_ = store_slices(_rows(docs, id_col, text, learn), "text", 2 * SLICE_BYTES)
    parts = parts_for(slices_, 2)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, count, _ = Tokens(from_blob(batch.column(1)[i].as_buffer())).pairs()
                keys, count = keys[count > 0], count[count > 0]
                part = part_of(keys, parts)
                for p in np.unique(part).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([keys[part == p].tobytes()]), pa.array([count[part == p].tobytes()])], names=["p", "keys", "counts"])

    def build(table: pa.Table) -> pa.Table:
        keys, inverse = np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=U64), return_inverse=True)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.int64)
        trie = build_part(keys, np.bincount(inverse, weights=counts, minlength=len(keys)))
        return pa.table({"p": table.column("p")[:1], "bigrams": pa.array([len(trie.codes)], pa.int64()), "trie": pa.array([trie.to_bytes()], pa.binary())})

    return slices_.mapInArrow(send, "p int, keys binary, counts binary").groupBy("p").applyInArrow(build, "p int, bigrams long, trie binary")


def score_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_texts(docs).select("doc_id", F.expr(f"coalesce({id_text()} % 10 = 0, false)").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
