"""Weighted prevalences and means with Taylor-linearized intervals.

Every estimate starts from ``measured`` rows (y, w, h, a): value, weight, stratum, PSU. A row without a weight
takes no part in weighted estimates and is counted in ``n_dropped_weight``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Design
from ..functions.predicates import as_flag, finite, in_codes, universe_filter

Z95 = 1.96


def substantive(df: DataFrame, variable: str, universe: str | None, valid: Sequence[int]) -> DataFrame:
    """Rows of the universe that hold a substantive answer."""
    return df.where(universe_filter(df, universe) & in_codes(df, variable, valid))


def measured(
    df: DataFrame,
    variable: str,
    *,
    universe: str | None,
    valid: Sequence[int] | None,
    design: Design,
    affirmative: Sequence[int] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """The rows an estimate is made of. With ``affirmative`` y is a 0/1 flag, else the value itself."""
    rows = df.where(universe_filter(df, universe)) if valid is None else substantive(df, variable, universe, valid)
    y = finite(df, variable) if affirmative is None else as_flag(in_codes(df, variable, affirmative))
    return rows.select(
        *by,
        y.alias("y"),
        finite(df, design.weight).alias("w"),
        F.col(design.stratum).alias("h"),
        F.col(design.psu).alias("a"),
    )


def _ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def prevalence(
    df: DataFrame,
    variable: str,
    *,
    universe: str | None,
    affirmative: Sequence[int],
    valid: Sequence[int],
    design: Design,
    weighted: bool = True,
    denominator: str = "valid",
    by: Sequence[str] = (),
) -> DataFrame:
    """Share of affirmative answers in percent; 0.0 when nobody qualifies.

    ``denominator="all_in_universe"`` counts a missing or reserved answer as "no", the classic mistake.
    """
    if denominator not in ("valid", "all_in_universe"):
        raise ValueError(f"unknown denominator: {denominator!r}")
    rows = measured(
        df, variable, universe=universe, valid=valid if denominator == "valid" else None,
        affirmative=affirmative, design=design, by=by,
    )
    w = F.col("w") if weighted else F.lit(1.0)
    return rows.groupBy(*by).agg(
        (100 * _ratio_or_zero(F.sum(w * F.col("y")), F.sum(w))).alias("value_pct"),
        F.count_if((F.col("y") == 1.0) & w.isNotNull()).alias("n_numerator"),
        F.count(w).alias("n_denominator"),
        F.coalesce(F.sum(w), F.lit(0.0)).alias("denominator_weighted"),
        F.count_if(w.isNull()).alias("n_dropped_weight"),
    )


def mean(
    df: DataFrame,
    variable: str,
    *,
    universe: str | None,
    valid: Sequence[int],
    design: Design,
    weighted: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean in the unit of the variable; 0.0 when nobody qualifies."""
    rows = measured(df, variable, universe=universe, valid=valid, design=design, by=by)
    w = F.col("w") if weighted else F.lit(1.0)
    return rows.groupBy(*by).agg(
        _ratio_or_zero(F.sum(w * F.col("y")), F.sum(w)).alias("value"),
        F.count(w).alias("n"),
        F.coalesce(F.sum(w), F.lit(0.0)).alias("denominator_weighted"),
        F.count_if(w.isNull()).alias("n_dropped_weight"),
    )


def psu_totals(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per PSU with its weighted total, weight and counts; the only shuffle that sees data rows."""
    return rows.groupBy(*by, "h", "a").agg(
        F.sum(F.col("w") * F.col("y")).alias("s_wy"),
        F.sum("w").alias("s_w"),
        F.count("w").alias("n"),
        F.count_if(F.col("w").isNull()).alias("n_dropped_weight"),
    )


def stratified_ratio(psus: DataFrame, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Ratio R = Σwy/Σw and its between-PSU variance from PSU totals.

    The residual total of a PSU is s_wy - R*s_w. With the ratio P of a stratum as pilot it is e + (P - R)*s_w, where e = s_wy - P*s_w, so its
    variance follows from moments of e and s_w. Both are as small as the residuals themselves, while those of s_wy and s_w would cancel where
    totals are large against residuals. P and R are sums over PSU and stratum rows: no data row is read again. Strata with one PSU add
    nothing. PSUs without a design key count in R but not in the variance. ``carry`` names further PSU columns to sum up.
    """
    usable = "(h IS NOT NULL AND a IS NOT NULL AND n > 0)"
    names = ", ".join(f"`{c}`" for c in by)
    stratum = f"OVER (PARTITION BY {names + ', ' if by else ''}h)"
    group = f"OVER (PARTITION BY {names})" if by else "OVER ()"
    pilot = f"coalesce(try_divide(sum(CASE WHEN {usable} THEN s_wy END) {stratum}, sum(CASE WHEN {usable} THEN s_w END) {stratum}), 0D)"
    around = psus.withColumn("pilot", F.expr(pilot))
    rest, bottom = f"CASE WHEN {usable} THEN s_wy - pilot * s_w END", f"CASE WHEN {usable} THEN s_w END"
    strata = around.groupBy(*by, "h").agg(*map(F.expr, [
        f"count_if({usable}) AS n_psu",
        "max(pilot) AS pilot",
        f"coalesce(count_if({usable}) * var_samp({rest}), 0D) AS m_ee",
        f"coalesce(count_if({usable}) * covar_samp({rest}, {bottom}), 0D) AS m_eb",
        f"coalesce(count_if({usable}) * var_samp({bottom}), 0D) AS m_bb",
        "sum(s_wy) AS s_wy",
        "sum(s_w) AS s_w",
        "sum(n) AS n",
        f"sum(CASE WHEN NOT {usable} THEN n END) AS n_dropped_design",
        "sum(n_dropped_weight) AS n_dropped_weight",
        *[f"sum({c}) AS {c}" for c in carry],
    ])).withColumn("r", F.expr(f"try_divide(sum(s_wy) {group}, sum(s_w) {group})"))
    spread = "greatest(sum(m_ee + 2 * (pilot - r) * m_eb + (pilot - r) * (pilot - r) * m_bb), 0D)"
    return strata.groupBy(*by).agg(*map(F.expr, [
        "max(r) AS ratio",
        f"try_divide({spread}, sum(s_w) * sum(s_w)) AS variance",
        "coalesce(sum(n), 0) AS n",
        "coalesce(sum(s_w), 0D) AS denominator_weighted",
        "coalesce(sum(n_psu), 0) AS n_psu",
        "count_if(n_psu > 0) AS n_strata",
        "coalesce(sum(n_dropped_weight), 0) AS n_dropped_weight",
        "coalesce(sum(n_dropped_design), 0) AS n_dropped_design",
        *[f"sum({c}) AS {c}" for c in carry],
    ]))


COUNTS = ("n", "denominator_weighted", "n_psu", "n_strata", "n_dropped_weight", "n_dropped_design")


def psu_variance(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Design variance of a weighted ratio."""
    return stratified_ratio(psu_totals(rows, by), by).select(
        *by, "variance", "n_psu", "n_strata"
    )


def design_effect(ratio: Column, variance: Column, n: Column) -> Column:
    """Design variance over simple-random-sampling variance; NULL when the latter is 0."""
    srs = F.try_divide(ratio * (1 - ratio), n)
    return F.when(srs > 0, F.try_divide(variance, srs))


def srs_half_width(ratio: Column, n: Column, z: float = Z95) -> Column:
    """Half-width under simple random sampling, the lower bound an honest design interval exceeds."""
    return z * F.sqrt(F.try_divide(ratio * (1 - ratio), n))


def prevalence_ci(
    df: DataFrame,
    variable: str,
    *,
    universe: str | None,
    affirmative: Sequence[int],
    valid: Sequence[int],
    design: Design,
    by: Sequence[str] = (),
    z: float = Z95,
) -> DataFrame:
    """Prevalence with its design-based interval and design effect, in percent."""
    rows = measured(
        df, variable, universe=universe, valid=valid, affirmative=affirmative, design=design, by=by
    )
    ratio, se = F.col("ratio"), F.sqrt("variance")
    return stratified_ratio(psu_totals(rows, by), by).select(
        *by,
        (100 * ratio).alias("estimate"),
        (100 * se).alias("se"),
        (100 * (ratio - z * se)).alias("lci"),
        (100 * (ratio + z * se)).alias("uci"),
        design_effect(ratio, F.col("variance"), F.col("n")).alias("deff"),
        (100 * srs_half_width(ratio, F.col("n"), z)).alias("srs_half_width"),
        *COUNTS,
    )


def mean_ci(
    df: DataFrame,
    variable: str,
    *,
    universe: str | None,
    valid: Sequence[int],
    design: Design,
    by: Sequence[str] = (),
    z: float = Z95,
) -> DataFrame:
    """Weighted mean with its design-based interval, in the unit of the variable."""
    rows = measured(df, variable, universe=universe, valid=valid, design=design, by=by)
    ratio, se = F.col("ratio"), F.sqrt("variance")
    return stratified_ratio(psu_totals(rows, by), by).select(
        *by,
        ratio.alias("estimate"),
        se.alias("se"),
        (ratio - z * se).alias("lci"),
        (ratio + z * se).alias("uci"),
        *COUNTS,
    )
