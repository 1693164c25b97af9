"""Centroid clustering in whole numbers, with Ptolemaic pivots.

Distances of every vector to a few fixed pivots are worked out once and stored beside it. In each round the distances of the
centroids to the pivots are known too, and Ptolemy's inequality over a pair of pivots p, s bounds the distance of vector o and centroid c from
below: d(o,c) >= |d(o,p) d(c,s) - d(o,s) d(c,p)| / d(p,s). Bounds are rounded down by more than floating point can err, so a centroid
is passed over only if it is surely farther than one already checked. All others are checked exactly, in whole numbers, and ties go
to the smaller number. Which vectors are pivots changes the work, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import stored
from tallyproof.llm.embeddings import matrix

SCALE = 1024
DIMENSIONS = 64
CELLS = 8
ROUNDS = 10
SEED = "3"
PIVOTS = 4
#: Pivots are chosen, far from each other, among so many vectors.
CANDIDATES = 64
#: Above 32 units of the last place of a double: products and quotients of square roots err by less.
SLACK = 2.0**-47
#: Squared distances of vectors below this in all components fit in 64 bits whatever their 64 or fewer components.
PLAIN = 1 << 27
LIMIT = 1 << 62
BATCH_ROWS = 4096


def whole(rows: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles; scale is a power of two, so products are exact. Beyond 2**62 a ValueError."""
    with np.errstate(over="ignore"):
        out = np.floor(rows * scale)
    if len(out) and not np.abs(out).max(initial=0) < LIMIT:
        raise ValueError(f"components of {LIMIT // scale} or more cannot be clustered")
    return out.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact: 64-bit numbers, or Python's where those might overflow."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) >= PLAIN * (64 / max(64, a.shape[-1])) ** 0.5:
        a, b = a.astype(object), b.astype(object)
    difference = a - b
    return (difference * difference).sum(axis=-1)


def roots(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64))


def spread(rows: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the rows, each the farthest from those before it (the first row first); equal rows once."""
    if not len(rows):
        return rows
    chosen, least = [0], roots(squared(rows, rows[:1]))
    while len(chosen) < count and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, roots(squared(rows, rows[chosen[-1]][None])))
    return rows[chosen]


class Pivots:
    """Fixed pivots and their pairs."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.pairs = [(p, s, float(roots(squared(rows[p: p + 1], rows[s: s + 1]))[0])) for p, s in combinations(range(len(rows)), 2)]

    def distances(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([roots(squared(rows, p[None])) for p in self.rows], axis=1) if len(self.rows) else np.zeros((len(rows), 0))

    def below(self, cached: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """A number surely not above the distance of each row, given its distances to the pivots, to each centroid."""
        far = self.distances(centres)
        out = np.zeros((len(cached), len(centres)))
        for p, s, apart in self.pairs:
            left, right = cached[:, p, None] * far[:, s], cached[:, s, None] * far[:, p]
            np.maximum(out, (np.abs(left - right) - SLACK * (left + right)) / apart, out=out)
        return out * (1 - SLACK)


def nearest(rows: np.ndarray, cached: np.ndarray, centres: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid (ties: the smaller number); how many distances were worked out."""
    below = pivots.below(cached, centres)
    first = below.argmin(axis=1)
    home, best, checked = first.copy(), squared(rows, centres[first]), len(rows)
    for c in range(len(centres)):
        open_ = np.flatnonzero((first != c) & (below[:, c] <= roots(best) * (1 + SLACK)))
        if not len(open_):
            continue
        here, now = squared(rows[open_], centres[c][None]), best[open_]
        checked += len(open_)
        won = (here < now) | ((here == now) & (c < home[open_]))
        if here.dtype == object and best.dtype != object:
            best = best.astype(object)
        best[open_[won]], home[open_[won]] = here[won], c
    return home, best, checked


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(a, BATCH_ROWS)


def _whole_rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def clustered(vectors: DataFrame, *, id_col: str = "vec_id", column: str = "embedding", cells: int = CELLS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
              seed: str = SEED, n_pivots: int = PIVOTS) -> DataFrame:
    """One row per kept row of ``vectors``: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite (zero vectors too), as whole numbers floor(1024 x).
    Centroids start as the ``cells`` vectors with the smallest sha256 of "<seed>:<vec_id>" (rows of equal id: by vector; rows without id come
    last), fewer if there are fewer. Repeated rows count each. A distance or sum that does not fit in 64 bits is null.
    Components of 2**52 or more are an error. Other columns are not read. An empty table: no rows.
    """
    spark = vectors.sparkSession
    good = usable_vectors(vectors, id_col, column, dimensions)
    chosen = good.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(max(cells, CANDIDATES)).select("v").toArrow()
    start = whole(matrix(chosen.column("v").combine_chunks())) if chosen.num_rows else np.zeros((0, dimensions), dtype=np.int64)
    pivots, centres = Pivots(spread(start[:CANDIDATES], n_pivots)), start[:cells]
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centres):
        return spark.createDataFrame([], result)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            rows = whole(matrix(part.column(1)))
            ends = pa.array(np.arange(0, len(rows) * dimensions + 1, dimensions, dtype=np.int32))
            cached = pivots.distances(rows)
            m = cached.shape[1]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1))),
                                              pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * m + 1, m, dtype=np.int32)), pa.array(cached.reshape(-1)))], names=["vec_id", "v", "cached"])

    ready = stored(good.mapInArrow(prepare, "vec_id long, v array<long>, cached array<double>"), "whole_vectors")

    def sums(centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(centres.shape, dtype=object), np.zeros(len(centres), dtype=np.int64)
            for part in _pieces(batches):
                rows = _whole_rows(part.column(0))
                home, _, _ = nearest(rows, _whole_rows(part.column(1)), centres, pivots)
                if np.abs(rows).max(initial=0) >= 1 << 50:
                    rows = rows.astype(object)
                for c in np.unique(home).tolist():
                    total[c] = total[c] + rows[home == c].sum(axis=0)
                count += np.bincount(home, minlength=len(centres))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(some, centres.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(centres.shape[1], dtype=np.int32), len(some))),
                pa.array([Decimal(int(x)) for c in some for x in total[c]], pa.decimal128(38, 0)), pa.array(np.repeat(count[some], centres.shape[1]))], names=["c", "place", "total", "n"])
        return run

    for _ in range(rounds):
        added = ready.select("v", "cached").mapInArrow(sums(centres), "c int, place int, total decimal(38,0), n long").groupBy("c", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        moved = centres.copy()
        for r in added:
            moved[r["c"], r["place"]] = int(r["total"]) // r["n"]
        if (moved == centres).all():
            break  # further rounds would change nothing
        centres = moved

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            home, best, _ = nearest(_whole_rows(part.column(1)), _whole_rows(part.column(2)), centres, pivots)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(home.astype(np.int32)), pa.array([int(x) if x < 1 << 63 else None for x in best], pa.int64())], names=["vec_id", "cluster", "distance"])

    found = stored(ready.mapInArrow(homes, "vec_id long, cluster int, distance long"), "clusters")
    # a row for each of the centroids, whose number is a parameter
    parts = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("none")).collect()}
    fits = lambda x, lost: int(x) if not lost and x < 1 << 63 else None
    inertia = fits(sum(r["d"] or 0 for r in parts.values()), any(r["none"] for r in parts.values()))
    about = [(c, fits(r["d"] or 0, r["none"]), inertia, hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, r in sorted(parts.items())]
    return found.join(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"), "cluster").select(*[x.split()[0] for x in result.split(", ")])


def usable_vectors(vectors: DataFrame, id_col: str, column: str, dimensions: int) -> DataFrame:
    """(vec_id, v) of the vectors that have ``dimensions`` components, none null or non-finite; v in doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.expr(f"transform(`{column}`, x -> double(x))").alias("v"))
    return rows.where(f"coalesce(size(v) = {dimensions} and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')), false)")
