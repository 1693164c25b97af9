"""Benchmark decontamination by suffix arrays of the training texts.

Each task cuts its documents into shards of about ``SHARD_BYTES`` of text (a longer text alone), sorts the word suffixes of a shard, and looks
up every suffix of every benchmark item in it by binary search. Nothing is shuffled: the items are the only thing that
is sent to tasks, in blocks of at most ``block_words`` words. A benchmark of more words takes further passes, each of
which adds what it found to the rows that the last one passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyproof.llm.common import ALNUM, hashed_words, list_array, new_name, runs

WINDOW = 10
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 2 << 20

#: What is found in a document. Words are counted from 0; spans are half-open and do not touch each other.
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_at", T.LongType()),
    T.StructField("longest_item", T.StringType()),
])


class TestBlock:
    """Words of some items, laid end to end, and their windows."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.words = np.concatenate([w for _, w in items] or [np.zeros(0, np.uint64)])
        sizes = np.array([len(w) for _, w in items], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        self.names = [name for name, _ in items]
        #: For each suffix: its item, its length, and the width of the window it starts with (0: too short for one).
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.left = np.repeat(first + sizes, sizes) - np.arange(len(self.words))
        width = np.minimum(np.repeat(sizes, sizes), window)
        self.width = np.where(self.left >= width, width, 0)
        self.depth = int(sizes.max()) if len(items) else 0
        #: The suffixes of the items themselves in order, to see which of them goes on longest with a text.
        self.known, ids = np.unique(self.words, return_inverse=True)
        at = np.arange(len(self.words)) + self.item
        self.spread = np.zeros(len(self.words) + len(items), dtype=np.int64)
        self.spread[at] = ids + 1
        self.suffix_of = np.full(len(self.spread), -1, dtype=np.int64)
        self.suffix_of[at] = np.arange(len(self.words))
        self.order = suffix_array(self.spread, self.depth)
        self.spread = np.concatenate([self.spread, np.zeros(self.depth + 1, dtype=np.int64)])


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` (0: between texts) in the order of their first ``depth`` symbols, up to the next 0.

    As many symbols as fit are packed into one sort key; only suffixes that are still tied are sorted by the next ones.
    """
    bits = max(1, int(ids.max(initial=0)).bit_length())
    step = max(1, 63 // bits)
    padded = np.concatenate([ids, np.zeros(depth + 2 * step, dtype=np.int64)])
    keys = padded[: len(ids) + depth + step].copy()
    for j in range(1, step):
        keys = (keys << bits) | padded[j: j + len(keys)]
    low = (1 << bits) - 1
    order = np.argsort(keys[: len(ids)])
    sorted_keys = keys[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    ended = (sorted_keys & low) == 0
    done = step
    while done < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied & ~ended)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        nxt = keys[order[at] + done]
        by = np.lexsort((nxt, group))
        order[at] = order[at][by]
        nxt = nxt[by]
        new[at[1:]] |= (nxt[1:] != nxt[:-1]) & (group[1:] == group[:-1])
        ended[at] = (nxt & low) == 0
        done += step
    return order


def _bound(ids: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, symbol: np.ndarray, right: bool) -> np.ndarray:
    """For each interval of the array: the first place whose symbol at ``depth`` is not below (right: is above) ``symbol``."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        have = ids[order[mid] + depth]
        go = have <= symbol[open_] if right else have < symbol[open_]
        lo[open_] = np.where(go, mid + 1, lo[open_])
        hi[open_] = np.where(go, hi[open_], mid)


def search(words: np.ndarray, bounds: np.ndarray, block: TestBlock) -> tuple[np.ndarray, ...]:
    """Occurrences of the block's windows in a shard: word position, width, suffix of the block, match length and its suffix.

    words: hashes of the shard's words; bounds: where each text starts in them. The match length is that of the longest
    verbatim match with any item from there on. Windows of equal words are reported once, with one of their suffixes.
    """
    known, ids = np.unique(words, return_inverse=True)
    # a 0 after each text: no match reaches over it
    spread = np.zeros(len(words) + len(bounds), dtype=np.int64)
    spread[np.arange(len(words)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = ids + 1
    order = suffix_array(spread, block.depth)
    spread = np.concatenate([spread, np.zeros(block.depth + 1, dtype=np.int64)])
    at = np.minimum(np.searchsorted(known, block.words), max(len(known) - 1, 0))
    symbols = np.where(known[at] == block.words, at + 1, -1) if len(known) else np.full(len(block.words), -1)

    suffix = np.arange(len(symbols))
    lo, hi = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), len(order), dtype=np.int64)
    window_lo, window_hi = np.zeros(len(suffix), dtype=np.int64), np.zeros(len(suffix), dtype=np.int64)
    active = suffix
    for depth in range(block.depth):
        active = active[block.left[active] > depth]
        active = active[symbols[active + depth] > 0]
        if not len(active):
            break
        symbol = symbols[active + depth]
        left = _bound(spread, order, lo[active], hi[active], depth, symbol, False)
        right = _bound(spread, order, left, hi[active], depth, symbol, True)
        lo[active], hi[active] = left, right
        active = active[left < right]
        full = active[block.width[active] == depth + 1]
        window_lo[full], window_hi[full] = lo[full], hi[full]
    hit = np.flatnonzero(window_hi > window_lo)
    _, one = np.unique(np.stack([window_lo[hit], window_hi[hit], block.width[hit]]), axis=1, return_index=True)
    one = hit[np.sort(one)]
    places = order[runs(window_lo[one], window_hi[one] - window_lo[one])]
    source = np.repeat(one, window_hi[one] - window_lo[one])
    # how far a text goes on with any suffix of the items: narrowed word by word in the items' own order
    mine = np.zeros(len(spread), dtype=np.int64)
    if len(words) and len(block.known):
        at = np.minimum(np.searchsorted(block.known, words), len(block.known) - 1)
        mine[np.arange(len(words)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = np.where(block.known[at] == words, at + 1, -1)
    low, high = np.zeros(len(places), dtype=np.int64), np.full(len(places), len(block.order), dtype=np.int64)
    length, go = np.zeros(len(places), dtype=np.int64), np.arange(len(places))
    for depth in range(block.depth):
        symbol = mine[places[go] + depth]
        go, symbol = go[symbol > 0], symbol[symbol > 0]
        left = _bound(block.spread, block.order, low[go], high[go], depth, symbol, False)
        right = _bound(block.spread, block.order, left, high[go], depth, symbol, True)
        more = left < right
        go, left, right = go[more], left[more], right[more]
        if not len(go):
            break
        low[go], high[go], length[go] = left, right, depth + 1
    best = block.suffix_of[block.order[low]] if len(places) else source
    text = np.searchsorted(bounds[1:] + np.arange(1, len(bounds)), places, side="right")
    return places - text, block.width[source], source, length, best


def same_windows(block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each window by its words; then the items of all classes laid end to end, and where each class starts."""
    starts = np.flatnonzero(block.width > 0)
    rows = np.full((len(starts), int(block.width.max(initial=0)) + 1), 0, dtype=np.uint64)
    rows[:, 0] = block.width[starts]
    for j in range(rows.shape[1] - 1):
        has = block.width[starts] > j
        rows[has, j + 1] = block.words[starts[has] + j]
    _, label = np.unique(rows, axis=0, return_inverse=True) if len(starts) else (None, np.zeros(0, np.int64))
    classes = np.full(len(block.words), -1, dtype=np.int64)
    classes[starts] = label.reshape(-1)
    pairs = np.unique(np.stack([classes[starts], block.item[starts]]), axis=1)
    return classes, pairs[1], np.searchsorted(pairs[0], np.arange(int(label.max(initial=-1)) + 2))


def _find(batches: Iterator[pa.RecordBatch], text: str, out: str, block, schema: pa.Schema, window: int, more: bool) -> Iterator[pa.RecordBatch]:
    from tallyproof.llm.common import slices

    block = block.value
    classes, class_items, class_at = same_windows(block)
    for batch in batches:
        for part in slices(batch, text, SHARD_BYTES):
            words, bounds = hashed_words(part.column(part.schema.get_field_index(text)), ALNUM)
            place, width, source, length, best = search(words, bounds, block)
            doc = np.searchsorted(bounds, place, side="right") - 1
            delta = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(delta, place, 1)
            np.add.at(delta, place + width, -1)
            hit = np.cumsum(delta[:-1]) > 0
            old = part.column(part.schema.get_field_index(out)).to_pylist() if more else None
            if more:
                for i, x in enumerate(old):
                    for a, b in zip(x["starts"], x["ends"], strict=True):
                        hit[bounds[i] + a: bounds[i] + b] = True
            edge = np.zeros(len(words) + 1, dtype=bool)
            edge[bounds] = True
            before, after = np.empty(len(words), dtype=bool), np.empty(len(words), dtype=bool)
            if len(words):
                before[0], before[1:] = False, hit[:-1]
                after[-1], after[:-1] = False, hit[1:]
            start = np.flatnonzero(hit & (~before | edge[:-1]))
            end = np.flatnonzero(hit & (~after | edge[1:])) + 1
            starts_at = np.searchsorted(start, bounds)
            of = np.repeat(np.arange(part.num_rows), np.diff(starts_at))
            pairs = np.unique(np.stack([doc, classes[source]]), axis=1)
            count = class_at[pairs[1] + 1] - class_at[pairs[1]]
            found = np.unique(np.stack([np.repeat(pairs[0], count), class_items[runs(class_at[pairs[1]], count)]]), axis=1)
            items = [[] for _ in range(part.num_rows)]
            for d, i in found.T.tolist():
                items[d].append(block.names[i])
            longest = [(0, None, None)] * part.num_rows
            for i in np.lexsort((place, -length, doc)).tolist():
                d = int(doc[i])
                if not longest[d][0]:
                    longest[d] = (int(length[i]), int(place[i] - bounds[d]), block.names[block.item[best[i]]])
            if more:
                for i, x in enumerate(old):
                    items[i] += x["items"]
                    longest[i] = max((x["longest"], x["longest_at"], x["longest_item"]), longest[i], key=lambda y: y[0])
            for i, names in enumerate(items):
                if names:
                    items[i] = sorted(set(names))
            value = pa.StructArray.from_arrays([
                pa.array(np.diff(bounds)), pa.array(items, pa.list_(pa.string())),
                list_array(pa.array(start - bounds[of]), starts_at), list_array(pa.array(end - bounds[of]), starts_at),
                pa.array([x[0] for x in longest], pa.int64()), pa.array([x[1] for x in longest], pa.int64()),
                pa.array([x[2] for x in longest], pa.string()),
            ], fields=list(schema.field(out).type))
            columns = [part.column(i) for i, name in enumerate(part.schema.names) if name != out]
            yield pa.RecordBatch.from_arrays([*columns, value], schema=schema)


def test_blocks(benchmark: DataFrame, window: int, block_words: int, id_col: str, text: str) -> Iterator[TestBlock]:
    """The items in blocks of at most ``block_words`` words (a longer item alone), read one partition after another."""
    items, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        words, _ = hashed_words(pa.array([row["t"]], pa.string()), ALNUM)
        if not len(words):
            continue
        if size and size + len(words) > block_words:
            yield TestBlock(items, window)
            items, size = [], 0
        items.append((row["i"], words))
        size += len(words)
    if items:
        yield TestBlock(items, window)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and that column's name: a struct of what of the benchmark occurs in each text.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is ``window`` consecutive words of an item;
    an item of fewer words is one window. ``starts``/``ends``: spans of words inside any occurrence of a window; ``items``:
    ids (as text, distinct, sorted) with an occurring window; ``longest``: length of the longest verbatim match, with its
    word position and item. Null and empty texts have no words and match nothing; so do null and empty items. Items
    that share an id count once; a null id is written as empty text. Repeated rows each get their own result.
    Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    out = new_name("found", docs.columns)
    more = False
    for block in test_blocks(benchmark, window, block_words, item_id, item_text):
        schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, FOUND)])
        docs = _pass(docs, spark.sparkContext.broadcast(block), text, out, schema, window, more)
        more = True
    if not more:
        docs = _pass(docs, spark.sparkContext.broadcast(TestBlock([], window)), text, out,
                     T.StructType([*docs.schema.fields, T.StructField(out, FOUND)]), window, False)
    return docs, out


def _pass(docs: DataFrame, block, text: str, out: str, schema: T.StructType, window: int, more: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return docs.mapInArrow(lambda batches: _find(batches, text, out, block, arrow, window, more), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; all columns as they were."""
    names = docs.columns
    found, out = match_benchmark(docs, benchmark, **options)
    return found.where(F.size(F.col(out)["starts"]) == 0).select(*[F.col(f"`{x}`") for x in names])


def items_sha256(ids: str) -> str:
    """SQL: SHA-256 of a list of texts, sorted and joined by commas."""
    return f"sha2(array_join({ids}, ','), 256)"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match."""
    found, out = match_benchmark(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.selectExpr(
        "doc_id", f"{out}.n_words as n_words",
        f"aggregate(zip_with({out}.ends, {out}.starts, (b, a) -> b - a), 0L, (x, y) -> x + y) as n_hit",
        f"cast(size({out}.items) as long) as n_items", f"{items_sha256(out + '.items')} as items_sha256",
        f"size({out}.starts) > 0 as contaminated",
        f"{out}.longest as longest", f"{out}.longest_at as longest_at", f"{out}.longest_item as longest_item")
