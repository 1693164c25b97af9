"""From raw documents to packed token sequences: five stages, each a table that the next one reads.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, with any
others that the table has. ``run`` applies them in order and writes each result to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.llm import decontamination, language, neardup, packing, repeats
from tallyproof.llm.common import id_text, importable, new_name, stored


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or letters go, and those that are like no learned language.

    The model learns from rows whose crc32(doc_id) mod 5 is not 0. If it knows no language (no labelled rows), only
    texts without a letter go.
    """
    importable(spark)
    model = language.fit(docs.where(f"{id_text()} % 5 != 0").select("doc_id", "text", "lang"))
    found, out = language.identify(docs, model)
    if model.families:
        found = found.where(F.col(f"{out}.like"))
    else:
        found = found.where(F.col("text").rlike(r"\p{L}"))
    return found.select(*[F.col(f"`{x}`") for x in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    importable(spark)
    return neardup.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more are kept where they occur first and cut out elsewhere; n_chars follows the text."""
    importable(spark)
    names = docs.columns
    if "n_chars" not in names:
        return repeats.remove_repeats(docs)
    before = new_name("length_before", names)
    cut = repeats.remove_repeats(docs.withColumn(before, F.length("text")))
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.when(F.length("text") != F.col(before), F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(
        *[F.col(f"`{x}`") for x in names])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item stand in a row."""
    importable(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    importable(spark)
    return packing.packing_digest(docs)


STAGES = [
    ("language", languages),
    ("near duplicates", near_copies),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("packing", packed),
]

#: Learned models and packing have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
