"""Token ids of whole texts by the tokenizers library, each distinct stretch of text encoded once per slice.

A byte-level BPE with the usual splitting never joins a character that is not white space with white space after it,
nor a letter with a punctuation mark after it. So a text falls into stretches, cut at such places, whose ids, one after
another, are the ids of the text. Distinct stretches are encoded by the library; all else is array work.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from tallyproof.llm.common import hash_spans, runs, texts_of

KEPT_BYTES = 6 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NO_END = _SPACE.copy()
_NO_END[28:32] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stretches(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Start of each stretch: of each text, of white space after a byte that surely isn't white space, of an ASCII
    punctuation mark after an ASCII letter."""
    begin = _SPACE[raw]
    if len(raw):
        begin[0] = False
        begin[1:] &= ~_NO_END[raw[:-1]]
    places = np.flatnonzero(begin)
    last, second, third = raw[places - 1], raw[np.maximum(places - 2, 0)], raw[np.maximum(places - 3, 0)]
    # white space outside ASCII: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000
    odd = (last >= 128) & (((second == 0xC2) & ((last == 0x85) | (last == 0xA0)))
                           | (((second == 0x80) | (second == 0x81) | (second == 0x9A)) & (third >= 0xE1) & (third <= 0xE3)))
    begin[places[odd]] = False
    begin[1:] |= _MARK[raw[1:]] & _LETTER[raw[:-1]]
    begin[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes string columns; what it has seen is kept (at most about ``KEPT_BYTES`` of text, then it starts anew).

    Stretches are known by 64-bit hash and length, in sorted arrays: as keys of a dictionary they would take four times the memory.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.splits = (spec.get("normalizer") is None and (spec.get("model") or {}).get("type") == "BPE" and not spec.get("truncation")
                       and not spec.get("padding") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True))
        self.marks = [x["content"].encode() for x in spec.get("added_tokens") or []]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids, self.count, self.bytes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and where each text's ids start. Null: no ids."""
        raw, at = texts_of(column)
        data = raw.tobytes()
        if not self.splits or any(m in data for m in self.marks):
            every = self._whole([data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in every])]).astype(np.int64)
            return np.fromiter((i for x in every for i in x), dtype=np.uint32, count=int(bounds[-1])), bounds
        start = stretches(raw, at)
        end = np.append(start[1:], len(raw)) if len(start) else start
        keys, one, same = np.unique(hash_spans(raw, start, end), return_index=True, return_inverse=True)
        if self.bytes > KEPT_BYTES:
            self._clear()
        start_, end_ = start[one], end[one]
        at_ = np.searchsorted(self.keys, keys)
        slots = np.full(len(keys), -1, dtype=np.int64)
        inside = np.flatnonzero(at_ < len(self.keys))
        known = inside[(self.keys[at_[inside]] == keys[inside]) & (self.size[at_[inside]] == (end_ - start_)[inside])]
        slots[known] = self.slot[at_[known]]
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            count, ids = [], []
            texts = [data[a:b].decode() for a, b in zip(start_[fresh].tolist(), end_[fresh].tolist(), strict=True)]
            for i in range(0, len(texts), 4096):
                for x in self._whole(texts[i: i + 4096]):
                    count.append(len(x))
                    ids += x
            slots[fresh] = len(self.count) + np.arange(len(fresh))
            self.keys, self.slot = np.insert(self.keys, at_[fresh], keys[fresh]), np.insert(self.slot, at_[fresh], slots[fresh])
            self.size = np.insert(self.size, at_[fresh], (end_ - start_)[fresh])
            self.bytes += int((end_ - start_)[fresh].sum())
            self.count = np.concatenate([self.count, np.array(count, dtype=np.int64)])
            self.ids = np.concatenate([self.ids, np.array(ids, dtype=np.uint32)])
            self.first = np.cumsum(self.count) - self.count
        if not len(start):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(at), dtype=np.int64)
        of = slots[same.reshape(-1)]
        count = self.count[of]
        ids = self.ids[runs(self.first[of], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(start, at)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ended(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, dtype=np.uint32)
    keep = np.ones(len(out), dtype=bool)
    keep[bounds[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, bounds + np.arange(n + 1)
