"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one vector of each group kept.

Centroids are fitted on a bounded sample; every vector is then put into its ``PROBES`` nearest cells. Two vectors are
compared if they have a cell in common, in the first such cell only, so a link is found once and for both. Large cells
are cut into blocks, and pairs of blocks are multiplied in separate tasks. A task gives back the number of links of each
vector and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import components, forest, stored

THRESHOLD = 0.9
PROBES = 6
CELL_ROWS = 2000
BLOCK_ROWS = 2048
SAMPLE = 20_000
MAX_CELLS = 4096


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, cells: int, *, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit rows; a cell that loses all rows starts anew from the row least like its centroid."""
    cells = max(1, min(cells, len(rows)))
    centre = rows[np.random.default_rng(seed).permutation(len(rows))[:cells]].copy()
    for _ in range(rounds):
        best, home = np.empty(len(rows)), np.empty(len(rows), dtype=np.int64)
        for a in range(0, len(rows), 8192):
            product = rows[a: a + 8192] @ centre.T
            home[a: a + 8192] = product.argmax(axis=1)
            best[a: a + 8192] = product.max(axis=1)
        order = np.argsort(home, kind="stable")
        used, at = np.unique(home[order], return_index=True)
        total = np.zeros_like(centre)
        total[used] = np.add.reduceat(rows[order], at, axis=0)
        empty = np.setdiff1d(np.arange(cells), used)
        total[empty] = rows[np.argsort(best, kind="stable")[: len(empty)]]
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centre = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centre)
    return centre


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(column: str) -> str:
    """SQL: the vector can be compared (not null, no null or non-finite component, not zero)."""
    return (f"coalesce({column} is not null and not exists({column}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
            f" and exists({column}, x -> x != 0), false)")


def _links(left: np.ndarray, right: np.ndarray, probes_l: np.ndarray, probes_r: np.ndarray, cell: int, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows with cosine at or above the threshold whose first common cell is this one; same: i < j only."""
    for a in range(0, len(left), 512):
        i, j = np.nonzero(left[a: a + 512] @ right.T >= threshold)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        for b in range(0, len(i), 1 << 16):
            p, q = i[b: b + (1 << 16)], j[b: b + (1 << 16)]
            common = np.where((probes_l[p][:, :, None] == probes_r[q][:, None, :]).any(axis=2), probes_l[p], np.iinfo(np.int32).max)
            own = common.min(axis=1) == cell
            if own.any():
                yield p[own], q[own]


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES,
                 sample: int = SAMPLE, max_cells: int = MAX_CELLS, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are linked when found with cosine (in doubles) at or above ``threshold``. Vectors that are null, zero, or hold null
    or non-finite components link with nothing, nor do vectors of different lengths with each other. Equal vectors are
    one node with a weight, so a vector that is repeated often costs nothing more; its copies are linked with each other.
    component_id is the smallest id reachable; rows that share an id are linked as their vectors are and share a component; a null id
    has a null component and is kept where no equal vector has an id. Other columns are not read. Empty table: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("v"))
    good = rows.where(usable("v"))
    nodes = stored(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("node", F.coalesce("id", F.xxhash64("v"))), "vectors")
    sizes = {r["d"]: r["n"] for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    centres = {}
    for d, n in sorted(sizes.items()):
        cells = min(max_cells, max(1, n * probes // cell_rows))
        chosen = nodes.where(F.size("v") == d).select("v", F.xxhash64("v").alias("h")).where(F.expr(f"pmod(h, 1000003) / 1000003.0D < {1.2 * sample / n}D")).orderBy("h").limit(sample)
        data = chosen.select("v").toArrow().column("v").combine_chunks()
        centres[d] = spherical_kmeans(unit(matrix(data)), cells) if cells > 1 and len(data) else np.zeros((1, d))
    first_cell = dict(zip(sorted(centres), np.cumsum([0, *(len(centres[d]) for d in sorted(centres))]).tolist(), strict=False))
    sent = spark.sparkContext.broadcast((centres, first_cell))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, first_cell = sent.value
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                for a in range(0, part.num_rows, 2048):
                    piece = part.slice(a, 2048)
                    product = unit(matrix(piece.column(0))) @ centres[d].T
                    t = min(probes, product.shape[1])
                    near = np.argpartition(-product, t - 1, axis=1)[:, :t] if t < product.shape[1] else np.tile(np.arange(t), (len(product), 1))
                    near = np.sort(near, axis=1).astype(np.int32) + np.int32(first_cell[d])
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, t, dtype=np.int32)), pa.array(near.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), piece.column(0), cells], names=["node", "n", "v", "cells"])

    doubles = nodes.select(F.expr("transform(v, x -> double(x))").alias("v"), "node", "n")
    placed = stored(doubles.mapInArrow(assign, "node long, n long, v array<double>, cells array<int>"), "placed")
    in_cells = placed.select("node", "n", "v", "cells", F.explode("cells").alias("cell"))
    # a cell of n rows is n / block_rows blocks; a row goes to every pair of blocks that its own is in
    wide = {r["cell"]: -(-r["c"] // block_rows) for r in in_cells.groupBy("cell").agg(F.count("*").alias("c")).where(f"c > {block_rows}").collect()}
    blocks = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(wide.items()) for x in kv])[F.col("cell")], F.lit(1)) if wide else F.lit(1)
    dealt = (in_cells.withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(node, cell), blocks) as int)"))
             .withColumn("other", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")))
             .select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "v", "cells"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cell, lo, hi = (table.column(k)[0].as_py() for k in range(3))
        block, node, n = (table.column(k).to_numpy() for k in (3, 4, 5))
        rows_, cells = unit(matrix(table.column(6).combine_chunks())), table.column(7).combine_chunks()
        cells = cells.flatten().to_numpy().reshape(len(rows_), -1)
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        count, root, a, b = np.zeros(len(rows_), dtype=np.int64), np.arange(len(rows_)), [], []
        for i, j in _links(rows_[left], rows_[right], cells[left], cells[right], cell, threshold, lo == hi):
            i, j = left[i], right[j]
            np.add.at(count, i, n[j])
            np.add.at(count, j, n[i])
            used = forest(root, i, j)
            a.append(i[used])
            b.append(j[used])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        some = np.flatnonzero(count)
        return pa.table({"node": np.concatenate([node[some], node[a]]), "other": pa.array(np.concatenate([np.zeros(len(some), np.int64), node[b]]), mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(a), bool)])),
                         "links": np.concatenate([count[some], np.zeros(len(a), np.int64)])})

    found = stored(dealt.groupBy("cell", "lo", "hi").applyInArrow(compare, "node long, other long, links long"), "vector_links")
    joined = components(found.where("other is not null").selectExpr("node as a", "other as b"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = (nodes.join(counts, "node", "left").join(joined, "node", "left")
               .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    linked = good.join(by_node, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(f"not {usable('v')}").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.expr("coalesce(vec_id = component_id, component_id is null)"))


def representatives(vectors: DataFrame, *, id_col: str = "vec_id", **options) -> DataFrame:
    """``vectors`` with the vector of the smallest id of each group; all columns as they were. Rows without id stay."""
    gone = near_vectors(vectors, id_col=id_col, **options).where("not kept and vec_id is not null").select(F.col("vec_id").alias("gone_id")).distinct()
    return vectors.join(gone, vectors[id_col] == gone["gone_id"], "left_anti")
