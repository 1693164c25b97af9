"""Single records, and what their columns mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.predicates import codes_sql, integer_sql, universe_filter
from ..functions.text import codes_text

WARNING = "These are single answers without weights. They show how the data is coded and estimate nothing."


def inspect_rows(
    df: DataFrame,
    columns: Sequence[str],
    *,
    limit: int,
    universe: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """``limit`` matching rows with the named columns; both are the caller's choice and are taken as they are.

    With ``order_by`` the choice of rows is repeatable, at the price of a scan of all matching rows; Spark keeps
    only the best rows of each task. Without it reading stops as soon as enough rows are found.
    """
    unknown = sorted(set(columns) - set(df.columns))
    if unknown or not columns:
        raise ValueError(f"no such columns: {', '.join(unknown)}" if unknown else "which columns shall be shown?")
    if limit <= 0:
        raise ValueError(f"a limit of {limit} shows no rows")
    rows = df.where(universe_filter(df, universe))
    rows = rows.orderBy(*order_by) if order_by else rows
    return rows.limit(limit).select(*columns)


def _meaning() -> Column:
    yes = F.when(F.size("affirmative_codes") > 0, F.concat(F.lit(" (yes: "), codes_text(F.col("affirmative_codes")), F.lit(")"))).otherwise("")
    notes = F.when(F.col("notes") != "", F.concat(F.lit(" "), "notes")).otherwise("")
    return F.concat(F.col("variable"), F.lit(" = "), "variable_label", F.lit("; codes "), codes_text(F.col("valid_codes")), yes,
                    F.lit("; "), "universe_text", notes)


def column_summary(columns: Sequence[str], catalog: Catalog, verified: DataFrame) -> DataFrame:
    """(place, variable, summary): the meaning of each column that a published document stands behind."""
    spark = verified.sparkSession
    asked = spark.createDataFrame(list(enumerate(columns)), "place int, variable string")
    backed = catalog.as_frame(spark).join(verified.select("variable").distinct(), "variable", "left_semi")
    unbacked = F.concat(F.col("variable"), F.lit(": nothing published explains this column"))
    return asked.join(backed.withColumn("meaning", _meaning()), "variable", "left").select(
        "place", "variable", F.coalesce("meaning", unbacked).alias("summary"))


def rows_with_meanings(
    df: DataFrame,
    columns: Sequence[str],
    catalog: Catalog,
    verified: DataFrame,
    *,
    limit: int,
    universe: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """(part, place, text): a warning, the meaning of each column, and ``limit`` rows as ``name=value`` lists."""
    present = [c for c in columns if c in df.columns]
    rows = inspect_rows(df, present, limit=limit, universe=universe, order_by=order_by)
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("missing"))) for c in present])
    place = F.row_number().over(Window.orderBy(*(order_by or [F.lit(0)])))  # over the rows shown only
    parts = [
        df.sparkSession.createDataFrame([("warning", 0, WARNING)], "part string, place int, text string"),
        column_summary(columns, catalog, verified).select(F.lit("column").alias("part"), "place", F.col("summary").alias("text")),
        rows.select(F.lit("row").alias("part"), place.alias("place"), shown.alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def code_counts(df: DataFrame, variables: Sequence[str], catalog: Catalog) -> DataFrame:
    """One row per variable and whole-number code that occurs: ``rows`` that hold it, and whether it is ``valid``.

    All variables share one scan, and counts are summed up before the shuffle, so a code of most rows costs one row per task and a
    column of many millions of codes as many rows, never a list. Missing values and fractions are no codes. Codes of
    a variable that are valid but never occur are in no row.
    """
    unknown = sorted(set(variables) - set(df.columns))
    if unknown or not variables:
        raise ValueError(f"which columns? no such columns: {', '.join(unknown)}" if unknown else "which columns?")
    found = [
        f"CASE WHEN {integer_sql(df, v)} THEN struct('{v}' AS variable, CAST(`{v}` AS BIGINT) AS code, "
        f"coalesce({codes_sql(df, v, catalog[v].valid)}, false) AS valid) END"
        for v in dict.fromkeys(variables)
    ]
    seen = df.selectExpr(f"inline(array({', '.join(found)}))").where("variable IS NOT NULL")
    return seen.groupBy("variable", "code", "valid").agg(F.count("*").alias("rows"))
