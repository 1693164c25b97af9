"""Requests for estimates, answered for published variables only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Design
from ..functions.predicates import validate_universe
from .batch import Domain, grouped_estimates, join_estimates
from .tables import STATS, grouped_table

REQUEST_SCHEMA = "request_id string, variable string, universe string, stat string, q double"
TABLE_REQUEST_SCHEMA = f"{REQUEST_SCHEMA}, groupby string"


def _answers(
    df: DataFrame, requests: DataFrame, verified: DataFrame, catalog: Catalog, design: Design
) -> DataFrame:
    """Requests with their estimates, one row per group value, or with the ``reason`` why there is none."""
    spark = df.sparkSession
    q = F.when(F.col("stat") == "quantile", F.coalesce("q", F.lit(0.5)))
    asked = requests.select("request_id", "variable", F.nullif("universe", F.lit("")).alias("universe"), "stat",
                            q.alias("q"), F.nullif("groupby", F.lit("")).alias("groupby"))
    allowed = asked.join(verified.select("variable").distinct(), "variable", "left_semi")
    domains, bad = [], []
    for row in allowed.select("variable", "universe", "stat", "q", "groupby").distinct().toLocalIterator():
        try:
            validate_universe(row["universe"], df.columns)
        except ValueError as error:
            bad.append((row["universe"], str(error)))
            continue
        grouping = row["groupby"] is None or _groups(df, row["groupby"])
        if grouping and row["variable"] in catalog and row["stat"] in STATS and (row["q"] is None or 0 <= row["q"] <= 1):
            domains.append(Domain(row["variable"], row["universe"], row["stat"], row["q"], row["groupby"]))
    estimates = grouped_estimates(df, domains, catalog, design).drop("domain_key")
    rejected = spark.createDataFrame(sorted(set(bad)), "universe string, rejection string")
    groupings = spark.createDataFrame([(c,) for c in df.columns if _groups(df, c)], "groupby string").withColumn("groups", F.lit(True))
    backed = verified.select("variable").distinct().withColumn("backed", F.lit(True))
    found = asked.join(backed, "variable", "left").join(rejected, "universe", "left").join(groupings, "groupby", "left")
    found = join_estimates(found, estimates, kind="stat", variable="variable", universe="universe", q="q", groupby="groupby")
    reason = (
        F.when(F.col("backed").isNull(), F.concat("variable", F.lit(" is not backed by a published document")))
        .when(F.col("rejection").isNotNull(), F.col("rejection"))
        .when(~F.col("stat").isin(*STATS), F.concat(F.lit("unknown statistic: "), "stat"))
        .when(F.coalesce(~F.col("q").between(0, 1), F.lit(False)), F.lit("q must lie between 0 and 1"))
        .when(F.col("groupby").isNotNull() & F.col("groups").isNull(),
              F.concat(F.lit("no column of numbers to group by: "), "groupby"))
        .when(F.col("estimate").isNull() & F.col("groupby").isNotNull(),
              F.concat(F.lit("nothing to tabulate: no row that counts has a group value of "), "groupby"))
        .when(F.col("estimate").isNull(), F.lit("empty subpopulation"))
    )
    return found.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "answered").otherwise("refused"))


def _groups(df: DataFrame, column: str) -> bool:
    return column in df.columns and isinstance(df.schema[column].dataType, T.NumericType)


_FIGURES = ("estimate", "lci", "uci", "se", "n", "denominator_weighted")


def _figures() -> list[Column]:
    return [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in _FIGURES]


def grounded_or_refuse(
    df: DataFrame, requests: DataFrame, verified: DataFrame, catalog: Catalog, design: Design
) -> DataFrame:
    """An estimate with its interval per request, or the reason why there is none.

    A request is refused for a variable without a published document, a universe outside the allowed form, an
    unknown statistic, or an empty subpopulation. All requests share the one scan of ``grouped_estimates``.
    """
    plain = requests.withColumn("groupby", F.lit(None).cast("string"))
    return _answers(df, plain, verified, catalog, design).select(
        "request_id", "variable", "universe", "stat", "q", "status", "reason", *_figures())


def grounded_tables(
    df: DataFrame, requests: DataFrame, verified: DataFrame, catalog: Catalog, design: Design
) -> DataFrame:
    """Requests for tables, or for single figures where ``groupby`` is null or empty: any number of both from one scan.

    One row per request and group value that has substantive rows; a request that is refused has one row with its reason and a NULL
    group value. Beyond the reasons of ``grounded_or_refuse``, a grouping column must be a column of numbers and leave
    some row to tabulate. Reserved codes of the grouping column make no group.
    """
    return _answers(df, requests, verified, catalog, design).select(
        "request_id", "variable", "universe", "stat", "q", "groupby", "group_value", "status", "reason", *_figures())


def grounded_table(
    df: DataFrame, verified: DataFrame, variable: str, groupby: str, *, catalog: Catalog, design: Design, **options
) -> DataFrame:
    """``grouped_table`` for a variable that a published document stands behind; others are refused with ValueError."""
    if verified.where(F.col("variable") == variable).isEmpty():
        raise ValueError(f"{variable} is not backed by a published document")
    return grouped_table(df, variable, groupby, catalog=catalog, design=design, **options)
