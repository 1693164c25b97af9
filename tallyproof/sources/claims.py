"""Claim tables: nested records as written by their authors, turned into one flat row per claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIM_SCHEMA = """
    id string, variable string, label string, analytical_universe string, seeded_defect boolean,
    links array<string>, prose string,
    claim struct<statistic: string, kind: string, quantile_q: double, unit: string,
        method: struct<universe_expr: string, weighted: boolean>,
        value: double, value_pct: double, tolerance: double, tolerance_pct: double, ci_95: array<double>>
"""

TREND_SCHEMA = """
    id string, canonical string, years array<int>, title string, seeded_defect boolean, links array<string>,
    prose string,
    claim struct<statistic: string,
        method: struct<per_year_variable: map<string, string>, single_variable: string>,
        values_pct: map<string, double>, tolerance_pct: double>
"""

_CORRUPT = "_malformed"

# Tolerances of claims that state none, in the unit of the claim.
DEFAULT_TOLERANCE = 0.5
DEFAULT_TREND_TOLERANCE = 0.3


def parsed_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, record, malformed) of JSON lines; blank lines are none.

    A line is malformed that is no JSON object, or in which any field does not fit the schema; it gives no record, so that no field is
    silently missing.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    whole = F.from_json("line", f"{schema.strip()}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT})
    found = lines.withColumn("record", whole)
    malformed = F.col("record").isNull() | F.col(f"record.{_CORRUPT}").isNotNull() | ~F.ltrim("line").startswith("{")
    return found.select("file", "line", F.when(~malformed, F.col("record").dropFields(_CORRUPT)).alias("record"), malformed.alias("malformed"))


def records_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("malformed")).select("record.*")


def malformed_records(spark: SparkSession, path: str, schema: str = "") -> DataFrame:
    """The lines of claims (or of the records of another schema) that cannot be read, for the quarantine: file, line."""
    return parsed_records(spark, path, schema or CLAIM_SCHEMA).where("malformed").select("file", "line")


def flat_claims(records: DataFrame) -> DataFrame:
    """Defaults and older keys resolved: ``value`` goes before ``value_pct``, ``tolerance`` before
    ``tolerance_pct``. A record without a claimed value is descriptive."""
    claim = F.col("claim")
    made = claim.isNotNull()
    kind = F.coalesce(claim["kind"], F.lit("prevalence"))
    return records.select(
        "id",
        "variable",
        F.coalesce("label", F.lit("")).alias("label"),
        "analytical_universe",
        F.coalesce(claim["statistic"], F.lit("")).alias("statistic"),
        kind.alias("kind"),
        claim["quantile_q"].alias("quantile_q"),
        F.coalesce(claim["unit"], F.when(kind == "prevalence", "%").otherwise("")).alias("unit"),
        F.nullif(claim["method"]["universe_expr"], F.lit("")).alias("method_universe"),
        F.when(made, F.coalesce(claim["method"]["weighted"], F.lit(True))).alias("method_weighted"),
        F.coalesce(claim["value"], claim["value_pct"]).alias("claimed"),
        F.coalesce(claim["tolerance"], claim["tolerance_pct"], F.lit(DEFAULT_TOLERANCE)).alias("tolerance"),
        F.get(claim["ci_95"], F.lit(0)).alias("claimed_low"),
        F.get(claim["ci_95"], F.lit(1)).alias("claimed_high"),
        F.coalesce("links", F.array().cast("array<string>")).alias("links"),
        F.trim(F.coalesce("prose", F.lit(""))).alias("prose"),
        F.coalesce("seeded_defect", F.lit(False)).alias("seeded_defect"),
    )


def load_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims from JSON lines. Lines that cannot be read whole are no claims: see ``malformed_records``."""
    return flat_claims(records_of(parsed_records(spark, path, CLAIM_SCHEMA)))


def _by_year(values: Column) -> Column:
    """JSON keys are text; years are numbers."""
    return F.transform_keys(values, lambda year, _: year.cast("int"))


def flat_trend_claims(records: DataFrame) -> DataFrame:
    claim = F.col("claim")
    return records.select(
        "id",
        "canonical",
        "years",
        F.coalesce("title", "id").alias("title"),
        F.coalesce(claim["statistic"], F.lit("")).alias("statistic"),
        _by_year(claim["method"]["per_year_variable"]).alias("per_year_variable"),
        claim["method"]["single_variable"].alias("single_variable"),
        F.coalesce(_by_year(claim["values_pct"]), F.create_map().cast("map<int,double>")).alias("values_pct"),
        F.coalesce(claim["tolerance_pct"], F.lit(DEFAULT_TREND_TOLERANCE)).alias("tolerance"),
        F.coalesce("links", F.array().cast("array<string>")).alias("links"),
        F.trim(F.coalesce("prose", F.lit(""))).alias("prose"),
        F.coalesce("seeded_defect", F.lit(False)).alias("seeded_defect"),
    )


def load_trend_claims(spark: SparkSession, path: str) -> DataFrame:
    """Trend claims from JSON lines; years are the keys of the value and variable maps."""
    return flat_trend_claims(records_of(parsed_records(spark, path, TREND_SCHEMA)))
