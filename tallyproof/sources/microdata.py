"""Reading microdata: CSV, its Parquet copy, and waves with different columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """The requested columns that exist, in the requested order; all columns when none are requested."""
    return df.columns if columns is None else [c for c in columns if c in df.columns]


def scan_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """CSV with a header. Without a schema Spark infers one, at the price of a second pass over the file.

    The types of a schema go to the columns of the same names, wherever they stand in the file; columns that it does not
    name are text. A line that does not fit its types, or a file with another header, is an error, never a NULL.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is None:
        df = reader.option("inferSchema", True).csv(path)
    else:
        kinds = {f.name: f for f in schema.fields}
        header = spark.read.option("header", True).csv(path).columns
        in_file = T.StructType([kinds.get(name, T.StructField(name, T.StringType())) for name in header])
        df = reader.option("enforceSchema", False).schema(in_file).csv(path)
        if columns is None:
            df = df.select(*[f"`{f.name}`" for f in schema.fields if f.name in header])
    return df.select(*[f"`{c}`" for c in present_columns(df, columns)])


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*present_columns(df, columns))


def last_modified(spark: SparkSession, path: str) -> float | None:
    """Latest modification time below a path, None if there is no file. File contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        moment = files.agg(F.max(F.unix_micros("modificationTime"))).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return moment


def materialize_parquet(
    spark: SparkSession, csv_path: str, parquet_path: str, *, schema: T.StructType | None = None, force: bool = False
) -> str:
    """Parquet copy of a CSV, rebuilt only when forced, missing, or older than the CSV."""
    if not force:
        copied = last_modified(spark, parquet_path)
        source = last_modified(spark, csv_path)
        if copied is not None and (source is None or copied >= source):
            return parquet_path
    scan_csv(spark, csv_path, schema=schema).write.mode("overwrite").parquet(parquet_path)
    return parquet_path


def load_microdata(
    spark: SparkSession,
    csv_path: str,
    parquet_path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The Parquet copy if there is one, else the CSV, else FileNotFoundError before any job on the data."""
    if last_modified(spark, parquet_path) is not None:
        return scan_parquet(spark, parquet_path, columns)
    if last_modified(spark, csv_path) is not None:
        return scan_csv(spark, csv_path, columns, schema)
    raise FileNotFoundError(f"neither {csv_path} nor {parquet_path} exists")


def scan_waves(frames: Mapping[int, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """All waves in one table with a ``wave`` column; a column a wave does not have is NULL there."""
    parts = [
        df.select(F.lit(wave).alias("wave"), *present_columns(df, columns)) for wave, df in sorted(frames.items())
    ]
    waves = parts[0]
    for part in parts[1:]:
        waves = waves.unionByName(part, allowMissingColumns=True)
    return waves


@dataclass(frozen=True)
class WaveTable:
    """All waves as one table with a ``wave`` column, and the names of the columns that each wave has."""

    rows: DataFrame
    columns: Mapping[int, frozenset[str]]

    def __iter__(self) -> Iterator[int]:
        return iter(sorted(self.columns))


def partition_waves(frames: Mapping[int, DataFrame], path: str) -> WaveTable:
    """Write all waves as one Parquet table partitioned by ``wave``, a list of their columns beside it, and open it.

    A column that a wave does not have is NULL there; columns of one name take the wider type of the two. A wave whose own
    data has a column ``wave`` is an error.
    """
    clash = sorted(w for w, df in frames.items() if "wave" in df.columns)
    if clash:
        raise ValueError(f"waves with a column named wave: {', '.join(map(str, clash))}")
    spark = next(iter(frames.values())).sparkSession
    scan_waves(frames).write.partitionBy("wave").parquet(f"{path}/rows")
    wave_columns(spark, frames).coalesce(1).write.parquet(f"{path}/columns")
    return open_waves(spark, path)


def open_waves(spark: SparkSession, path: str) -> WaveTable:
    """A table written by ``partition_waves``; only the short list of columns is read here."""
    names: dict[int, set[str]] = {}
    for row in spark.read.parquet(f"{path}/columns").collect():
        names.setdefault(row["wave"], set()).add(row["column"])
    rows = spark.read.parquet(f"{path}/rows")
    return WaveTable(rows, {wave: frozenset(columns) for wave, columns in names.items()})


def wave_columns(spark: SparkSession, waves: Mapping[int, DataFrame] | WaveTable) -> DataFrame:
    """One row per wave and column, from the schemas alone."""
    have = waves.columns if isinstance(waves, WaveTable) else {wave: df.columns for wave, df in waves.items()}
    return spark.createDataFrame(
        [(wave, column) for wave in sorted(have) for column in sorted(have[wave])], "wave int, column string")
