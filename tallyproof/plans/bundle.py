"""The whole chain from microdata to the published bundle."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utc_stamp
from ..operators import docs as D
from ..operators import trends as TR
from ..operators import verify as V
from ..operators.batch import batch_estimates
from ..session import shared_dir, written
from ..sources import bundle as B
from ..sources.claims import malformed_records
from ..sources.microdata import last_modified
from .claims import claims, claims_path, trend_claims
from .micro import CATALOG, DESIGN, WAVES, micro, wave_frames

SOURCE = "answer sheets on deliveries"

# id, question; the last one shares no word with any document
QUESTIONS = [
    (1, "How large is the share of lines sent back?"),
    (2, "median weeks until a case was settled"),
    (3, "How large is the mean discount of a unit?"),
    (4, "share in several waves"),
    (5, "zzyzx quux"),
]


@dataclass(frozen=True)
class Bundle:
    claims: DataFrame
    estimates: DataFrame
    verdicts: DataFrame
    trend_claims: DataFrame
    trend_verdicts: DataFrame
    docs: DataFrame
    snapshot: B.Snapshot


TABLES = ("claims", "estimates", "verdicts", "trend_claims", "trend_verdicts")


def _root(spark: SparkSession, sf_dir: str) -> str:
    """The folder for the bundle of this application and data: data that has changed has another."""
    about = [spark.sparkContext.applicationId, sf_dir, *[last_modified(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier")]]
    return shared_dir(spark, f"bundles/{hashlib.md5(repr(about).encode()).hexdigest()}")


def data_stamp(spark: SparkSession, sf_dir: str) -> str:
    """The last moment that the data tell of, as documents cite it."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.agg(F.coalesce(utc_stamp(F.max("l_shipdate").cast("timestamp")), F.lit("")).alias("stamp")).first()["stamp"]


def compile_bundle(spark: SparkSession, sf_dir: str, path: str) -> B.Snapshot:
    """Verify all claims and publish what holds, with verdicts and documents as tables of one version."""
    stamp = data_stamp(spark, sf_dir)
    stated = written(claims(spark, sf_dir), "claims")
    data = micro(spark, sf_dir)
    estimates = written(batch_estimates(data, V.claim_domains(stated, data, CATALOG), CATALOG, DESIGN), "estimates")
    verdicts = written(V.judge(stated, estimates, CATALOG), "verdicts")

    stated_trends = written(trend_claims(spark, sf_dir), "trend_claims")
    waves = wave_frames(spark, sf_dir)
    trend_verdicts = written(TR.verify_trends(stated_trends, waves, WAVES), "trend_verdicts")

    docs = D.concept_docs(verdicts, stated, CATALOG, stamp=stamp, source=SOURCE)
    if TR.waves_missing(stated_trends, waves).isEmpty():
        docs = docs.unionByName(D.trend_docs(trend_verdicts, stated_trends, stamp=stamp, source=SOURCE))
    log = V.audit_log(verdicts, trend_verdicts, utc_stamp(F.current_timestamp()), malformed_records(spark, claims_path(spark, sf_dir)))
    return B.publish_bundle(docs, verdicts, log, path, dict(zip(TABLES, (stated, estimates, verdicts, stated_trends, trend_verdicts), strict=True)))


def _opened(found: B.Snapshot) -> Bundle:
    return Bundle(*[found.table(name) for name in TABLES], found.table("published"), found)


def republish(spark: SparkSession, sf_dir: str) -> Bundle:
    """Compile the bundle anew; its version is the one that later reads use."""
    return _opened(compile_bundle(spark, sf_dir, _root(spark, sf_dir)))


def published(spark: SparkSession, sf_dir: str) -> Bundle:
    """The current version for these data, compiled where there is none."""
    found = B.snapshot(spark, _root(spark, sf_dir))
    return _opened(found) if found else republish(spark, sf_dir)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id int, question string")
