"""The published bundle as tables: documents, quarantine, audit log.

A bundle is a folder of versions. A version is written once and never changed; one small record among the commits makes it the current
one. So readers see a whole version or none of it: a compile that fails between two tables leaves the version before.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.docs import parse_documents
from .microdata import last_modified

_COMMIT = "number long, version string"


@dataclass(frozen=True)
class Snapshot:
    """One committed version. It stays the same while later versions are published."""

    spark: SparkSession
    path: str
    number: int
    version: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions/{self.version}/{name}")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The versions of a bundle that were committed, with their numbers."""
    if last_modified(spark, f"{path}/commits") is None:
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).json(f"{path}/commits")


def snapshot(spark: SparkSession, path: str) -> Snapshot | None:
    """The current version: the largest number, of equal ones (two writers at once) the last name. None if there is none yet."""
    row = commits(spark, path).orderBy(F.col("number").desc(), F.col("version").desc()).first()
    return Snapshot(spark, path, row["number"], row["version"]) if row else None


def publish_bundle(docs: DataFrame, verdicts: DataFrame, log: DataFrame, path: str, more: Mapping[str, DataFrame] | None = None) -> Snapshot:
    """Write documents, failed claims, audit log (and ``more`` tables by name) as a new version, and commit it last."""
    spark, version = docs.sparkSession, uuid.uuid4().hex
    tables = {"published": docs, "quarantine": verdicts.where(F.col("verdict") == "FAIL"), "audit": log, **(more or {})}
    for name, table in tables.items():
        table.write.parquet(f"{path}/versions/{version}/{name}")
    before = snapshot(spark, path)
    number = before.number + 1 if before else 1
    spark.createDataFrame([(number, version)], _COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")
    return Snapshot(spark, path, number, version)


def scan_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the current version."""
    found = snapshot(spark, path)
    if found is None:
        raise FileNotFoundError(f"nothing was published in {path}")
    return found.table("published")


def scan_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit logs of all committed versions, with the number of the version that wrote them."""
    made = commits(spark, path).collect()
    if not made:
        raise FileNotFoundError(f"nothing was published in {path}")
    logs = spark.read.parquet(*[f"{path}/versions/{r['version']}/audit" for r in made])
    of = F.regexp_extract(F.col("_metadata.file_path"), "/versions/([0-9a-f]+)/audit/", 1)
    return logs.withColumn("version", of).join(spark.createDataFrame(made, _COMMIT), "version").drop("version")


def scan_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Documents from markdown files, one file each."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1)
    return parse_documents(files.select(name.alias("id"), F.col("value").alias("raw")))
