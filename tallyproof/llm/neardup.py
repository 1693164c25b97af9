"""Near-duplicate texts by HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

Steps: (1) one pass over the texts makes the set of hashed shingles of each, its 128-bit digest, ``BUCKETS`` registers
(leading zeros and mantissa of the smallest hash of a bucket) and its band keys: those of the registers, or for sets of
up to ``SMALL`` shingles, which leave most buckets empty, those of one smallest hash for each of as many hash functions
(sets near that size have both kinds, so that no pair falls between them); (2) texts with equal sets become one node; (3) nodes that share a band key are candidates: each is paired with the pivot of its bucket, and
the pair's similarity is estimated from the registers; (4) pairs that may reach the threshold are verified on their full
sets; (5) members of a pivot's buckets that are still in different components are compared on their full sets, block by
block. So each candidate pair is verified, ruled out by its estimate, or joined already, and a large group of near
copies costs a pass over its members where its pivot is like them.

Chances: with 51 bands of 5 a pair at similarity 0.75 shares no band once in a million by hash functions; by registers,
which depend on each other, about once in 100,000 (a model of 4000 pairs of 64 and 48, 128 and 96, 256 and 192 shingles:
1.2, 1.1 and 1.0 in 100,000). The margin below the threshold is five standard deviations of the estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import SPACED, U64, components, forest, hashed_words, list_array, mix, slices, stored

SHINGLE = 5
PERCENT = 75
BUCKETS = 256
ROWS = 5
BANDS = 51
MANTISSA = 10
MARGIN = 5.0
PROBES = 32
#: Sets of up to so many shingles have keys of hash functions.
SMALL = 64
#: Rows of a block in which members of a bucket are compared.
BLOCK = 512

_rng = np.random.default_rng(20240608)
_ODD = _rng.integers(1, 2**62, 16, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_PERM = np.stack([_rng.permutation(BUCKETS) for _ in range(PROBES + 1)])
_BAND = _rng.integers(1, 2**62, BANDS, dtype=np.int64).astype(U64)
_SMALL_BAND = _rng.integers(1, 2**62, BANDS, dtype=np.int64).astype(U64)
_SMALL_ODD = _rng.integers(1, 2**62, BANDS * ROWS, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, laid end to end, and where each text's begin.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Fewer words than ``size``: one shingle of all; none: no shingle.
    """
    words, bounds = hashed_words(column, SPACED)
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    h = np.zeros(len(words), dtype=U64)
    if len(words):
        padded = np.concatenate([words, np.zeros(size, dtype=U64)])
        place = np.arange(len(words)) - np.repeat(bounds[:-1], n)
        left = np.repeat(n, n) - place
        for j in range(size):
            h += np.where(left > j, mix(padded[j: j + len(words)] + _ODD[8]) * _ODD[j], U64(0))
        h = mix(h + np.minimum(left, size).astype(U64))
    text = np.repeat(np.arange(len(n)), n)
    use = (np.arange(len(words)) - np.repeat(bounds[:-1], n)) < np.repeat(count, n)
    return distinct(text[use], h[use], len(n))


def distinct(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order, and where each text's begin."""
    order = np.argsort(h)
    small = np.uint16 if n < 1 << 16 else np.int64
    order = order[np.argsort(text[order].astype(small), kind="stable")]
    text, h = text[order], h[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[first], np.searchsorted(text[first], np.arange(n + 1))


def registers(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (texts x BUCKETS, uint16; 0: empty) of ascending distinct hashes of each text.

    The top 8 bits of a hash name its bucket. Of the smallest rest in a bucket, the number of leading zeros and the
    ``MANTISSA`` bits behind the first one-bit are stored.
    """
    out = np.zeros((len(at) - 1, BUCKETS), dtype=np.uint16)
    if not len(h):
        return out
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bucket = (h >> U64(56)).astype(np.int64)
    first = np.ones(len(h), dtype=bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1])
    rest = ((h[first] << U64(8)) >> U64(11)).astype(np.int64)  # 53 bits
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    mantissa = ((rest << (53 - bits)) >> (52 - MANTISSA)) & ((1 << MANTISSA) - 1)
    out[text[first], bucket[first]] = 1 + ((53 - bits) << MANTISSA) + mantissa
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers in which an empty bucket holds what a fixed sequence of other buckets finds first: equal sets stay equal,
    and two sets agree in a filled bucket with the chance with which they agree in a full one."""
    out = regs.copy()
    text, bucket = np.nonzero(regs == 0)
    for probe in _PERM[:PROBES]:
        if not len(text):
            return out
        found = regs[text, probe[bucket]]
        out[text, bucket] = found
        text, bucket = text[found == 0], bucket[found == 0]
    order = _PERM[PROBES]
    nth = (regs[:, order] != 0).argmax(axis=1)
    out[text, bucket] = regs[text, order[nth[text]]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """BANDS keys (int64) of each row of filled registers."""
    return _keys(regs[:, : BANDS * ROWS].astype(U64), _BAND)


def small_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS keys (int64) of each set of hashes (none empty): each register is the smallest value of one hash function of
    its own, so registers of two sets agree with their similarity, independently of each other, however small they are."""
    least = np.empty((len(at) - 1, BANDS * ROWS), dtype=U64)
    if len(least):
        for j, odd in enumerate(_SMALL_ODD):
            least[:, j] = np.minimum.reduceat(h * odd, at[:-1])
    return _keys(least, _SMALL_BAND)


def _keys(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    part = values.reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(seeds, part.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key + part[:, :, j] * _ODD[j])
    return key.view(np.int64)


def candidate_keys(h: np.ndarray, at: np.ndarray, regs: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets end to end, and where each set's begin: of hash functions up to ``SMALL`` shingles, of registers
    for all that can reach the threshold with a larger set."""
    n = np.diff(at)
    small, large = (n > 0) & (n <= SMALL), 100 * n >= percent * (SMALL + 1)
    few = small_keys(h[np.repeat(small, n)], np.concatenate([[0], np.cumsum(n[small])]))
    many = band_keys(filled(regs[large]))
    owner = np.concatenate([np.repeat(np.flatnonzero(small), BANDS), np.repeat(np.flatnonzero(large), BANDS)])
    keys = np.concatenate([few.reshape(-1), many.reshape(-1)])[np.argsort(owner, kind="stable")]
    return keys, np.concatenate([[0], np.cumsum(BANDS * (small.astype(np.int64) + large))])


def _collisions() -> tuple[np.ndarray, np.ndarray]:
    """Chance that the registers of a bucket agree for two disjoint sets, by elements per bucket (powers of two)."""
    zeros = np.arange(40)[:, None]
    edge = 2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA))
    wide = 2.0 ** -(zeros + 1) / (1 << MANTISSA)
    low, high = edge.reshape(-1), (edge + wide).reshape(-1)
    rate = 2.0 ** np.arange(-8, 25, 0.5)
    cell = np.exp(-rate[:, None] * low) * -np.expm1(-rate[:, None] * (high - low))
    return np.log2(rate), cell @ cell.T


_table: list[np.ndarray] = []


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected estimate of the Jaccard similarity of rows of registers, and how many buckets it rests on."""
    if not _table:
        _table.extend(_collisions())
    rates, chance = _table
    used = (a != 0) | (b != 0)
    full = np.maximum(used.sum(axis=1), 1)
    same = ((a == b) & used).sum(axis=1)
    at = [np.clip(np.searchsorted(rates, np.log2(np.maximum(n, 1) / BUCKETS)), 0, len(rates) - 1) for n in (n_a, n_b)]
    p = chance[at[0], at[1]]
    by_chance = p * np.maximum(full - same, 0)
    return np.maximum(same - by_chance, 0) / full, full


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Stored (doc_id, n_shingles, f1, f2, regs, keys): a digest of each set, its registers and its band keys."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, at = shingle_sets(part.column(1))
                n = np.diff(at)
                total = np.concatenate([np.zeros((2, 1), dtype=U64), np.cumsum(np.stack([mix(h + _ODD[9]), mix(h ^ _ODD[10])]), axis=1, dtype=U64)], axis=1)
                digest = (total[:, at[1:]] - total[:, at[:-1]]).view(np.int64)
                regs = registers(h, at)
                keys, keys_at = candidate_keys(h, at, regs, percent)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n), pa.array(digest[0]), pa.array(digest[1]),
                    pa.array([x.tobytes() for x in regs], pa.binary()), list_array(pa.array(keys), keys_at),
                ], names=["doc_id", "n_shingles", "f1", "f2", "regs", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, regs binary, keys array<long>"), "signatures")


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose estimate may reach the threshold, with it: (a, b, est), stored."""
    regs = nodes.select("node", "n_shingles", "regs")
    rows = (pairs.join(regs.selectExpr("node as a", "n_shingles as n_a", "regs as r_a"), "a")
            .join(regs.selectExpr("node as b", "n_shingles as n_b", "regs as r_b"), "b")
            .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS) for k in (3, 5))
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 4))
            est, full = estimate(a, b, n_a, n_b)
            keep = est >= percent / 100 - MARGIN * np.sqrt(percent / 100 * (1 - percent / 100) / full)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], names=["a", "b", "est"])
            yield out.filter(pa.array(keep))

    return stored(rows.select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(judge, "a long, b long, est double"), "estimated")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold, stored. texts: (node, text) of all nodes in pairs."""
    rows = pairs.select("a", "b").join(texts.selectExpr("node as a", "text as text_a"), "a").join(texts.selectExpr("node as b", "text as text_b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                h_a, at_a = shingle_sets(part.column(2), size)
                for i, other in _slices_at(part, 3):
                    h_b, at_b = shingle_sets(other, size)
                    n = len(at_b) - 1
                    n_a, n_b = np.diff(at_a[i: i + n + 1]), np.diff(at_b)
                    _, at = distinct(np.concatenate([np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)]), np.concatenate([h_a[at_a[i]: at_a[i + n]], h_b]), n)
                    union = np.diff(at)
                    keep = 100 * (n_a + n_b - union) >= percent * union
                    yield part.slice(i, n).select([0, 1]).filter(pa.array(keep & (union > 0)))

    return stored(rows.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "verified")


def _slices_at(part: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.Array]]:
    """Where each run of rows with about a slice of text in ``column`` begins, and its texts."""
    at = 0
    for piece in slices(part.select([column]), part.schema.names[column]):
        yield at, piece.column(0)
        at += piece.num_rows


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right (distinct values in each)."""
    h = np.concatenate([*left, *right]) if left or right else np.zeros(0, dtype=U64)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    keys, inverse = np.unique(h, return_inverse=True)
    on_left = row < len(left)
    both = (np.bincount(inverse[on_left], minlength=len(keys)) > 0) & (np.bincount(inverse[~on_left], minlength=len(keys)) > 0)
    column = np.cumsum(both) - 1
    use = both[inverse]
    row, column = row[use], column[inverse[use]]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(both.sum()), 4096):  # incidence matrices of 4096 shingles at a time
        lo, hi = np.searchsorted(column, [a, a + 4096])
        cells = np.zeros((len(left) + len(right), 4096), dtype=np.float32)
        cells[row[lo:hi], column[lo:hi] - a] = 1
        out += cells[: len(left)] @ cells[len(left):].T
    return out


def residual(groups: DataFrame, joined: DataFrame, texts: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """Links between members of a group (pivot, node) that are in different components, verified on full sets: (a, b), stored.

    In each group the largest component is compared with all other members, and those with each other, block by block:
    a row is copied to the blocks it meets, pairs are never rows, and a task gives back a spanning forest of its links.
    """
    rows = groups.join(joined, "node", "left").select("pivot", "node", F.coalesce("component", "node").alias("c"))
    counts = rows.groupBy("pivot", "c").agg(F.count("*").alias("n"))
    about = counts.groupBy("pivot").agg(F.max(F.struct("n", "c")).alias("main"), F.sum("n").alias("all")).where("all > main.n").select(
        "pivot", F.col("main.c").alias("main"), F.expr(f"cast(ceil(main.n / {BLOCK}) as int)").alias("mains"), F.expr(f"cast(ceil((all - main.n) / {BLOCK}) as int)").alias("others"))
    rows = stored(rows.join(about, "pivot"), "mixed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, at = shingle_sets(part.column(1), size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["node", "h"])

    of = texts.join(rows.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "text").mapInArrow(sets, "node long, h binary")
    rows = rows.join(of, "node").withColumn("rest", F.expr("c != main")).withColumn(
        "block", F.expr("cast(pmod(xxhash64(node), if(rest, others, mains)) as int)"))
    meet = "struct({0} as same, cast({1} as int) as i, cast({2} as int) as j)"
    dealt = rows.withColumn("to", F.explode(F.expr(
        f"if(rest, concat(transform(sequence(0, mains - 1), k -> {meet.format('false', 'block', 'k')}),"
        f" transform(sequence(0, others - 1), k -> {meet.format('true', 'least(block, k)', 'greatest(block, k)')})),"
        f" transform(sequence(0, others - 1), k -> {meet.format('false', 'k', 'block')}))")))
    dealt = dealt.select("pivot", "to.same", "to.i", "to.j", "rest", "block", "node", "c", "h")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        same, i, j = (table.column(k)[0].as_py() for k in (1, 2, 3))
        rest, block, node, c = (table.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6, 7))
        every = [np.frombuffer(x, dtype=U64) for x in table.column(8).to_pylist()]
        left = np.flatnonzero(block == i) if same else np.flatnonzero(rest)
        right = np.flatnonzero(block == j) if same else np.flatnonzero(~rest)
        shared = overlaps([every[k] for k in left], [every[k] for k in right])
        n = np.array([len(x) for x in every])
        union = n[left][:, None] + n[right][None, :] - shared
        a, b = np.nonzero((100 * shared >= percent * union) & (c[left][:, None] != c[right][None, :]))
        names, label = np.unique(c, return_inverse=True)
        used = forest(np.arange(len(names)), label[left[a]], label[right[b]])
        return pa.table({"a": node[left[a][used]], "b": node[right[b][used]]})

    return stored(dealt.groupBy("pivot", "same", "i", "j").applyInArrow(compare, "a long, b long"), "residual")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of five-word shingles; component_id is the
    smallest doc_id reachable by links. Null and empty texts have no shingles and stay alone. Rows with equal sets are one
    node, named by their smallest id; rows that share an id are one document, so what links one links all of them. A row
    without id takes part in its text's node, or is kept with a null component where no row of that text has an id. Other
    columns are not read. Empty table: no rows.
    """
    sign = signatures(docs, id_col=id_col, text=text, percent=percent)
    classes = sign.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"))
    nodes = stored(sign.join(classes, ["f1", "f2"]).where("doc_id = node").select("node", "n_shingles", "regs", "keys"), "nodes")
    bands = nodes.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(bands.join(shared, "key"), "members")
    # the pivot of a bucket is its member that meets most others in all its buckets: in a family of copies, the original
    weight = members.groupBy("node").agg(F.sum("n").alias("w"))
    pivots = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", F.expr("-node").alias("m"))).alias("x")).select("key", F.expr("-x.m").alias("pivot"))
    groups = stored(members.join(pivots, "key").select("pivot", "node").distinct(), "groups")
    source = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text"))
    # by shuffle at every size: the list of nodes grows with the corpus, so the plan for small ones would not last
    texts = stored(source.join(groups.select("node").distinct().hint("merge"), "node", "left_semi"), "texts")

    pairs = groups.where("node != pivot").selectExpr("least(node, pivot) a", "greatest(node, pivot) b").distinct()
    links = verified(estimated(pairs, nodes, percent), texts, percent)
    joined = components(links)
    more = residual(groups, joined, texts, percent)
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    named = classes.join(joined, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component"))
    return (sign.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.expr("coalesce(doc_id = component_id, component_id is null)")))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group of near copies, that with the smallest id; all columns as they were.

    Rows that repeat the id of a kept document stay, as do rows without id whose text no other row has.
    """
    found = near_duplicates(docs, id_col=id_col, **options)
    gone = stored(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(gone.hint("merge"), docs[id_col] == gone["gone_id"], "left_anti")
