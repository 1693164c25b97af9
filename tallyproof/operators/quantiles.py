"""Weighted quantiles and Woodruff intervals.

Rows are ordered by (value, weight). All rows of one value form a run, and only the first and the last
midpoint of a run matter for the interpolation, so the ordered step works on distinct values: their number is
bounded by the code list, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import Design
from ..session import written
from .estimates import COUNTS, Z95, measured, stratified_ratio

_BUCKETS = 1_024
WHOLE = "whole"  # key column of an estimate without groups


def value_cells(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weight mass per PSU and value: bounded by design times code list, and enough for every later step."""
    w = F.col("w")
    return rows.groupBy(*by, "h", "a", "y").agg(
        F.sum(w).alias("s"),
        F.count(w).alias("n"),
        F.min(F.when(w > 0, w)).alias("low"),
        F.max(F.when(w > 0, w)).alias("high"),
        F.count_if(w.isNull()).alias("n_dropped_weight"),
    )


def value_runs(mass: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weight mass per value. Runs without weight carry no mass and make no knot."""
    return (
        mass.groupBy(*by, "y")
        .agg(F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where(F.col("s") > 0)
    )


def running_weight(
    runs: DataFrame, by: Sequence[str], codes: Sequence[int], masses: Sequence[str] = ("s",)
) -> DataFrame:
    """Adds to each run ``c_s``, the weight ``s`` up to and including the run, and ``total_s``.

    The value range is cut into buckets: totals per bucket are accumulated first and added to sums within buckets, so no
    task orders more than a bucket of a code list, however long it is.
    """
    everything = Window.partitionBy(*by)
    if len(codes) == 0:
        return runs.select("*", *[F.lit(0.0).alias(f"{c}_{m}") for c in ("c", "total") for m in masses]).where("false")
    width = (max(codes) - min(codes) + 1) / _BUCKETS
    cut = runs.withColumn("bucket", F.floor((F.col("y") - min(codes)) / width))
    before = everything.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*by, "bucket").agg(*[F.sum(m).alias(f"bucket_{m}") for m in masses]).select(
        *by, "bucket",
        *[F.coalesce(F.sum(f"bucket_{m}").over(before), F.lit(0.0)).alias(f"offset_{m}") for m in masses],
        *[F.sum(f"bucket_{m}").over(everything).alias(f"total_{m}") for m in masses],
    )
    within = Window.partitionBy(*by, "bucket").orderBy("y")
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.join(offsets, [*by, "bucket"])
        .select("*", *[(F.col(f"offset_{m}") + F.sum(m).over(within)).alias(f"c_{m}") for m in masses])
        .drop("bucket", *[f"offset_{m}" for m in masses])
    )


def knots(runs: DataFrame, by: Sequence[str], codes: Sequence[int]) -> DataFrame:
    """First and last midpoint of every run on the cumulative weight scale [0, 1]."""
    return running_weight(runs, by, codes).select(
        *by,
        "y",
        ((F.col("c_s") - F.col("s") + 0.5 * F.col("low")) / F.col("total_s")).alias("k_first"),
        ((F.col("c_s") - 0.5 * F.col("high")) / F.col("total_s")).alias("k_last"),
    )


def interpolate(q: str, y: str = "y", first: str = "k_first", last: str = "k_last") -> Column:
    """Aggregate over knots: piecewise linear lookup at ``q``, clamped at both ends.

    ``q`` is SQL text that is constant within a group: a number or a column.
    """
    left = (f"max(CASE WHEN {last} <= {q} THEN struct({last} AS x, {y} AS v) "
            f"WHEN {first} <= {q} THEN struct({first} AS x, {y} AS v) END)")
    right = (f"min(CASE WHEN {first} > {q} THEN struct({first} AS x, {y} AS v) "
             f"WHEN {last} > {q} THEN struct({last} AS x, {y} AS v) END)")
    slope = f"try_divide({right}.v - {left}.v, {right}.x - {left}.x)"
    return F.expr(
        f"CASE WHEN {left} IS NULL THEN {right}.v WHEN {right} IS NULL THEN {left}.v "
        f"ELSE {left}.v + (max({q}) - {left}.x) * {slope} END"
    )


def number_sql(value: float) -> str:
    return f"{float(value)!r}D"


def quantile(
    df: DataFrame,
    variable: str,
    q: float,
    *,
    universe: str | None,
    valid: Sequence[int],
    design: Design,
    weighted: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Quantile by interpolation between midpoints of cumulative weight; 0.0 when nobody qualifies."""
    rows = measured(df, variable, universe=universe, valid=valid, design=design, by=by)
    if not weighted:
        rows = rows.withColumn("w", F.lit(1.0))
    w = F.col("w")
    mass = rows.groupBy(*by, "y").agg(
        F.sum(w).alias("s"), F.count(w).alias("n"),
        F.min(F.when(w > 0, w)).alias("low"), F.max(F.when(w > 0, w)).alias("high"),
        F.count_if(w.isNull()).alias("n_dropped_weight"),
    )
    # Runs without weight stay in for the counts; they make no knot and add nothing to the running sum.
    marks = running_weight(mass.withColumn("s", F.coalesce("s", F.lit(0.0))), by, valid)
    k_first = F.when(F.col("s") > 0, (F.col("c_s") - F.col("s") + 0.5 * F.col("low")) / F.col("total_s"))
    k_last = F.when(F.col("s") > 0, (F.col("c_s") - 0.5 * F.col("high")) / F.col("total_s"))
    return (
        marks.withColumn("k_first", k_first).withColumn("k_last", k_last)
        .groupBy(*by)
        .agg(
            F.coalesce(interpolate(number_sql(q)), F.lit(0.0)).alias("value"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.coalesce(F.sum("s"), F.lit(0.0)).alias("denominator_weighted"),
            F.coalesce(F.sum("n_dropped_weight"), F.lit(0)).alias("n_dropped_weight"),
        )
    )


def quantile_ci(
    df: DataFrame,
    variable: str,
    q: float,
    *,
    universe: str | None,
    valid: Sequence[int],
    design: Design,
    by: Sequence[str] = (),
    z: float = Z95,
) -> DataFrame:
    """Weighted quantile with Woodruff's interval.

    The standard error is that of the cumulative share at the point estimate, so ``se`` is a probability; the
    bounds are mapped back to the unit of the variable. The data rows are scanned once, into a written table of
    cells; calling this function runs that scan.
    """
    keys = tuple(by) or (WHOLE,)
    rows = measured(df, variable, universe=universe, valid=valid, design=design, by=by)
    if not by:
        rows = rows.withColumn(WHOLE, F.lit(0))
    cells = written(value_cells(rows, keys), "value_cells")
    marks = knots(value_runs(cells, keys), keys, valid)
    found = woodruff(cells, marks, number_sql(q), keys, z=z)
    if not by:  # one row also when there is nothing to estimate
        found = found.agg(*[F.max(c).alias(c) for c in found.columns if c != WHOLE])
        found = found.fillna(0, ["n", "denominator_weighted", "n_psu", "n_strata"])
    return found.select(*by, "estimate", "se", "lci", "uci", *COUNTS)


def woodruff(
    cells: DataFrame, marks: DataFrame, q: str, by: Sequence[str], extra: Sequence[Column] = (), z: float = Z95
) -> DataFrame:
    """Point, standard error of its cumulative share, and bounds, from cells and their knots; one row per group.

    ``q`` is SQL text and may depend on the group, ``extra`` are further aggregates of the knots. Tables with one row per group
    are broadcast: groups are capped.
    """
    point = marks.groupBy(*by).agg(interpolate(q).alias("estimate"))
    below = F.when(F.col("y") <= F.col("estimate"), F.col("s")).otherwise(0.0)
    psus = (
        cells.join(point, list(by))
        .groupBy(*by, "h", "a")
        .agg(
            F.sum(below).alias("s_wy"),
            F.sum("s").alias("s_w"),
            F.sum("n").alias("n"),
            F.sum("n_dropped_weight").alias("n_dropped_weight"),
        )
    )
    spread = stratified_ratio(psus, by).withColumn("se", F.sqrt("variance"))
    reach = spread.selectExpr(
        *by, "se", *COUNTS,
        f"greatest(0D, {q} - {number_sql(z)} * se) AS p_low", f"least(1D, {q} + {number_sql(z)} * se) AS p_high",
    )
    return (
        marks.join(reach, list(by))
        .groupBy(*by)
        .agg(
            interpolate(q).alias("estimate"),
            F.max("se").alias("se"),
            interpolate("p_low").alias("lci"),
            interpolate("p_high").alias("uci"),
            *[F.max(c).alias(c) for c in COUNTS],
            *extra,
        )
    )
