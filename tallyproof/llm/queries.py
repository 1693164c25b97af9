"""One query per operator over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyproof.llm import clusters, decontamination, embeddings, html, idfiles, language, licenses, neardup, ngrams, packing, quality, repeats, spelling, sql
from tallyproof.llm.common import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op12_quality_rules": sql.quality_sql(), "op13_centroid_clusters": sql.clusters_sql()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.document_digests(idfiles.write_id_files(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(table(spark, sf_dir, "documents"))


@query
def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


@query
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_digest(table(spark, sf_dir, "documents"))


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(table(spark, sf_dir, "pages"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"))
