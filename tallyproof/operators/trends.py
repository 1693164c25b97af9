"""Estimates across waves whose columns were renamed or recoded, and checks of trend claims."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import WaveCatalog, WaveVariable
from ..functions.predicates import as_flag, finite, in_codes
from ..session import written
from ..sources.microdata import WaveTable, wave_columns

# A domain of at most this many codes, none above this value, is categorical.
CATEGORICAL_CODES = 12
CATEGORICAL_MAX = 20


#: Waves as a table each, or all of them in one table partitioned by wave.
Waves = Mapping[int, DataFrame] | WaveTable


def _answer(df: DataFrame, e: WaveVariable) -> list[Column]:
    """A row's answer to a measure."""
    return [
        F.lit(e.canonical).alias("canonical"),
        finite(df, e.variable).alias("v"),
        as_flag(in_codes(df, e.variable, e.affirmative)).alias("yes"),
        finite(df, e.weight).alias("w"),
    ]


def _answers(df: DataFrame, wave: Column, asked: Iterable[tuple[WaveVariable, Column]]) -> DataFrame:
    """The substantive answers of the rows of a table; ``asked`` has each measure with the test for the rows it was asked of.

    One measure is a filter. Of several, a row has one struct each, NULL where it has no answer.
    """
    asked = [(e, here & in_codes(df, e.variable, e.valid)) for e, here in asked]
    if len(asked) == 1:
        (e, given), = asked
        return df.where(given).select(wave.alias("wave"), *_answer(df, e))
    found = F.inline(F.array(*[F.when(given, F.struct(*_answer(df, e))) for e, given in asked]))
    return df.select(wave.alias("wave"), found).where(F.col("canonical").isNotNull())


def wave_answers(waves: Waves, entries: Iterable[WaveVariable]) -> DataFrame:
    """Substantive answers of all waves, each measure read from its own column, weight and codes.

    A row carries all its measures, exploded just before the aggregation. Waves in one table take one scan of the partitions
    that hold a measure asked for, separate tables one each. A wave that lacks the column or the weight of one of its
    measures is an error: no share can be made up for it.
    """
    together = isinstance(waves, WaveTable)
    asked: dict[int, list[WaveVariable]] = {}
    for e in entries:
        if e.wave in waves.columns if together else e.wave in waves:
            asked.setdefault(e.wave, []).append(e)
    for wave, here in sorted(asked.items()):
        have = waves.columns[wave] if together else set(waves[wave].columns)
        lacking = sorted({c for e in here for c in (e.variable, e.weight)} - set(have))
        if lacking:
            raise ValueError(f"wave {wave} has no column {', '.join(lacking)}")
    if not asked:
        raise ValueError("no wave holds any of the columns asked for")
    if together:
        rows = waves.rows.where(F.col("wave").isin(*sorted(asked)))
        return _answers(rows, F.col("wave"), [(e, F.col("wave") == wave) for wave in sorted(asked) for e in asked[wave]])
    parts = [_answers(waves[wave], F.lit(wave), [(e, F.lit(True)) for e in here]) for wave, here in sorted(asked.items())]
    return reduce(DataFrame.unionByName, parts)


def value_table(waves: Waves, entries: Iterable[WaveVariable]) -> DataFrame:
    """Counts and weight per measure, wave and value. Bounded by the code lists; enough for shares and domains."""
    return wave_answers(waves, entries).groupBy("canonical", "wave", "v").agg(
        F.max("yes").alias("yes"),
        F.sum("w").alias("s_w"),
        F.count("w").alias("n"),
        F.count("*").alias("answers"),
    )


def _wave_summary(waves: Waves, catalog: WaveCatalog) -> DataFrame:
    """Share and domain per measure and wave, from one aggregation."""
    share = F.try_divide(F.sum(F.col("yes") * F.col("s_w")), F.sum("s_w"))
    categorical = (F.count("v") <= CATEGORICAL_CODES) & (F.max("v") <= CATEGORICAL_MAX)
    found = value_table(waves, catalog).groupBy("canonical", "wave").agg(
        (100 * share).alias("value_pct"),
        F.sum("n").alias("n_denominator"),
        F.coalesce(F.sum("s_w"), F.lit(0.0)).alias("denominator_weighted"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.count("v").alias("cardinality"),
        F.when(categorical, "categorical").otherwise("continuous").alias("seen_encoding"),
    )
    declared = catalog.as_frame(found.sparkSession)
    declared = declared.select("canonical", "wave", "variable", "encoding")
    return declared.join(found, ["canonical", "wave"], "left").select(
        "canonical", "wave", "variable",
        "value_pct",
        F.coalesce("n_denominator", F.lit(0)).alias("n_denominator"),
        F.coalesce("denominator_weighted", F.lit(0.0)).alias("denominator_weighted"),
        "lo", "hi",
        F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
        F.coalesce("seen_encoding", "encoding").alias("encoding"),
    )


def trend_prevalence(waves: Waves, canonical: str, catalog: WaveCatalog) -> DataFrame:
    """Weighted share per wave, each wave with its own variable, weight and codes; NULL where no answer has a weight."""
    entries = [e for e in catalog if e.canonical == canonical]
    if not entries:
        raise KeyError(f"{canonical!r} is not in the wave catalog")
    share = F.try_divide(F.sum(F.col("w") * F.col("yes")), F.sum("w"))
    return wave_answers(waves, entries).groupBy("wave").agg(
        (100 * share).alias("value_pct"),
        F.count_if((F.col("yes") == 1.0) & F.col("w").isNotNull()).alias("n_numerator"),
        F.count("w").alias("n_denominator"),
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("denominator_weighted"),
    )


def empirical_domain(waves: Waves, catalog: WaveCatalog) -> DataFrame:
    """Range, number of distinct values and encoding of each measure in each wave."""
    return _wave_summary(waves, catalog).select(
        "canonical", "wave", "variable", "encoding", "lo", "hi", "cardinality"
    )


def _used_columns(claims: DataFrame, catalog: WaveCatalog) -> DataFrame:
    """One row per claim and year: the column the claim says it used and the right one."""
    right = catalog.as_frame(claims.sparkSession).select(
        "canonical", F.col("wave").alias("year"), F.col("variable").alias("right_variable")
    )
    years = claims.select("id", "canonical", "per_year_variable", "single_variable", "values_pct", "tolerance",
                          F.posexplode("years").alias("place", "year"))
    mapped = F.size(F.coalesce("per_year_variable", F.create_map().cast("map<int,string>"))) > 0
    used = F.when(mapped, F.col("per_year_variable")[F.col("year")]).otherwise(F.col("single_variable"))
    return years.withColumn("used", F.nullif(used, F.lit(""))).join(right, ["canonical", "year"], "left")


def rename_gap(claims: DataFrame, waves: Waves, catalog: WaveCatalog) -> DataFrame:
    """Claimed columns that a wave does not have, with the column that should have been used."""
    have = wave_columns(claims.sparkSession, waves).select(
        F.col("wave").alias("year"), F.col("column").alias("used")
    )
    return (
        _used_columns(claims, catalog).where(F.col("used").isNotNull())
        .join(have, ["year", "used"], "left_anti")
        .select("id", "year", "place", "used", "right_variable")
    )


def encoding_guard(claims: DataFrame, domains: DataFrame) -> DataFrame:
    """Claims whose waves hold incompatible codings: different encodings or ranges that do not meet."""
    years = claims.select("id", "canonical", F.posexplode("years").alias("place", "wave"))
    shown = F.format_string("%d %s is %s (%.0f to %.0f, %d values)", "wave", "variable", "encoding",
                            "lo", "hi", "cardinality")
    grouped = years.join(domains, ["canonical", "wave"]).groupBy("id").agg(
        F.size(F.collect_set("encoding")).alias("encodings"),
        F.max("lo").alias("max_lo"),
        F.min("hi").alias("min_hi"),
        F.array_sort(F.collect_list(F.struct("place", shown.alias("text")))).alias("shown"),
    )
    apart = (F.col("encodings") > 1) | F.coalesce(F.col("max_lo") > F.col("min_hi"), F.lit(False))
    return grouped.select(
        "id", "encodings", "max_lo", "min_hi", apart.alias("refused"),
        F.when(apart, F.concat(
            F.lit("the waves use different scales: "),
            F.array_join(F.transform("shown", lambda s: s["text"]), ", "),
            F.lit("; no trend can be computed"),
        )).alias("guard"),
    )


def _messages(rows: DataFrame, text: Column) -> DataFrame:
    """Messages per claim in the order of its years."""
    ordered = F.array_sort(F.collect_list(F.struct("place", text.alias("text"))))
    return rows.groupBy("id").agg(F.transform(ordered, lambda m: m["text"]).alias("messages"))


def verify_trends(claims: DataFrame, waves: Waves, catalog: WaveCatalog) -> DataFrame:
    """A verdict per trend claim: renamed columns, then the encoding guard, then the values.

    The data are read once, into a written summary of a row per measure and wave; calling this runs that scan. When the guard
    refuses, no values are computed for the claim. Yearly values are compared after rounding.
    """
    spark = claims.sparkSession
    summary = written(_wave_summary(waves, catalog), "wave_summary")  # a few rows that three steps below read
    known = spark.createDataFrame([(c,) for c in sorted({e.canonical for e in catalog})], "canonical string")

    gaps = _messages(
        rename_gap(claims, waves, catalog),
        F.format_string("%d: column %s is not in this wave, it was renamed; the right column is %s",
                        "year", "used", F.coalesce("right_variable", F.lit("unknown"))),
    ).withColumnRenamed("messages", "gap")
    guard = encoding_guard(claims, summary).select("id", "refused", "guard")

    right = summary.select("canonical", F.col("wave").alias("year"), F.round("value_pct", 2).alias("right_value"))
    years = _used_columns(claims, catalog).join(right, ["canonical", "year"], "left")
    stated = F.col("values_pct")[F.col("year")]
    off = (
        F.when(stated.isNull(), F.format_string("%d: no value is claimed", "year"))
        .when(F.col("right_value").isNull(), F.format_string("%d: no data for this wave", "year"))
        .when(
            F.abs(stated - F.col("right_value")) > F.col("tolerance"),
            F.format_string("%d: claimed %.2f%%, right is %.2f%%, tolerance %.2f", "year", stated,
                            "right_value", "tolerance"),
        )
    )
    values = years.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(off.isNotNull(), F.struct("place", off.alias("text"))))).alias("off"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("right_value").isNotNull(), F.struct("year", "right_value"))))).alias("right_values"),
    ).select("id", "right_values", F.transform("off", lambda m: m["text"]).alias("off"))

    refused = F.coalesce("refused", F.lit(False))
    unknown = F.col("known").isNull()
    none = F.array().cast("array<string>")
    diagnosis = F.concat(
        F.coalesce("gap", none),
        F.when(unknown, F.array(F.concat(F.lit("unknown measure: "), F.col("canonical")))).otherwise(none),
        F.when(refused, F.array("guard")).otherwise(none),
        F.when(refused | unknown, none).otherwise(F.coalesce("off", none)),
    )
    judged = (
        claims.join(gaps, "id", "left").join(guard, "id", "left").join(values, "id", "left")
        .join(known.withColumn("known", F.lit(True)), "canonical", "left")
        .withColumn("diagnosis", diagnosis)
        .withColumn("lint_ok", (F.col("prose") != "") & ~unknown)
    )
    verdict = F.when(F.size("diagnosis") == 0, "PASS").otherwise("FAIL")
    return judged.select(
        "id", "canonical", "statistic",
        verdict.alias("verdict"),
        "lint_ok",
        ((verdict == "FAIL") & F.col("lint_ok")).alias("caught"),
        F.col("values_pct").alias("claimed_values"),
        F.when(refused | unknown, F.create_map().cast("map<int,double>")).otherwise(F.col("right_values"))
        .alias("right_values"),
        "diagnosis", "seeded_defect",
    )


def waves_missing(claims: DataFrame, waves: Waves) -> DataFrame:
    """Years that trend claims need and no wave provides; trends are published only when there are none."""
    needed = claims.select(F.explode("years").alias("year")).distinct()
    have = claims.sparkSession.createDataFrame([(w,) for w in waves], "year int")
    return needed.join(have, "year", "left_anti")
