"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import unknown_variables
from ..functions import predicates as P
from ..functions import text as X
from ..operators import docs as D
from ..operators import estimates as E
from ..operators import quantiles as Q
from ..operators import requests as R
from ..operators import rows as RW
from ..operators import search as S
from ..operators import tables as TB
from ..operators import trends as TR
from ..operators import verify as V
from ..operators.batch import batch_estimates
from ..session import scratch_dir
from ..sources import bundle as B
from ..sources import claims as CL
from ..sources import microdata as M
from ..survey import Survey
from . import claims as C
from .bundle import data_stamp, published, questions, republish
from .micro import CATALOG, DESIGN, EARLY, LATE, MAY_CLAIM, MIDDLE, PAID_BACK, SENT_BACK, WAVES, micro, wave_frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SLICE = ("resp_id", "yr", "outcome", "paid", "refund", "wait", "cut", "quarter", "wt", "stratum", "cluster", "not_there")
MIXED = "(refund != 2) & (outcome == 3) | paid == 1 & wait >= 30"
PROBES = (
    "spend<=40",
    "((cut > 6))",
    "cut > 2 & cut <= 7 | quarter != 4",
    "spend != 12.5",
    "wt >= 300 | (qty < 3 & refund == 2)",
    "qty = 3",
    "(qty == 3",
    "qty == 3 & ",
    "qty == cut",
    "not qty == 3",
    "3 == qty",
    "size(qty) > 1",
    "boots == 3",
    "qty == 3; drop table t",
)
INSPECTED = ("refund", "quarter", "wait", "spend", "no_column")
LOOKUPS = (0.1, 0.5, 0.9)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits (weight sums to 4), because the order of summation differs between runs."""
    return df.select(*[
        F.round(F.col(f.name), 4 if f.name.startswith(("denominator", "sum_", "s_", "c_", "total")) else 6)
        .alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def joined(name: str, separator: str = "; "):
    return F.array_join(F.col(name).cast("array<string>"), separator).alias(name)


def survey(spark: SparkSession, sf_dir: str) -> Survey:
    return Survey(micro(spark, sf_dir), CATALOG, DESIGN)


# --- sources and sinks -------------------------------------------------------------------------------------


def _csv_copy(spark: SparkSession, sf_dir: str) -> tuple[str, T.StructType]:
    data, path = micro(spark, sf_dir), f"{scratch_dir(spark)}/micro_csv"
    data.write.option("header", True).csv(path)
    return path, data.schema


@query
def scan_csv(spark, sf_dir):
    path, schema = _csv_copy(spark, sf_dir)
    data = M.scan_csv(spark, path, ["outcome", "wt", "not_there"], schema)
    return tidy(data.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("wt").alias("sum_wt")))


@query
def scan_parquet(spark, sf_dir):
    lines = M.scan_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", "l_extendedprice", "not_there"])
    return tidy(lines.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_extendedprice").alias("sum_price")))


@query
def materialize_parquet(spark, sf_dir):
    path, schema = _csv_copy(spark, sf_dir)
    copy = f"{scratch_dir(spark)}/micro_parquet"
    M.materialize_parquet(spark, path, copy, schema=schema)
    M.materialize_parquet(spark, path, copy, schema=schema)  # fresh: nothing is rebuilt
    return tidy(M.scan_parquet(spark, copy).groupBy("quarter").agg(
        F.count("*").alias("n"), F.count("refund").alias("n_refund"), F.sum("wt").alias("sum_wt"),
        F.sum("wait").alias("wait_total")))


@query
def load_microdata(spark, sf_dir):
    path, schema = _csv_copy(spark, sf_dir)
    copy = M.materialize_parquet(spark, path, f"{scratch_dir(spark)}/micro_parquet", schema=schema)
    data = M.load_microdata(spark, path, copy, SLICE, schema)
    return data.groupBy("yr").agg(
        F.count("*").alias("n"), F.count("wait").alias("n_wait"), F.sum("cut").alias("cut_total"))


@query
def scan_waves(spark, sf_dir):
    waves = M.scan_waves(wave_frames(spark, sf_dir))
    return waves.groupBy("wave").agg(
        F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in ("result", "outcome", "cut_pm", "cut", "paid")])


@query
def load_claims(spark, sf_dir):
    return C.claims(spark, sf_dir).select(
        "id", "variable", "kind", "unit", "method_universe", "method_weighted", "claimed", "tolerance",
        F.round("claimed_low", 2).alias("claimed_low"), F.round("claimed_high", 2).alias("claimed_high"),
        joined("links"), "seeded_defect")


@query
def load_trend_claims(spark, sf_dir):
    return C.trend_claims(spark, sf_dir).select(
        "id", "canonical", joined("years", ","), "single_variable", "tolerance", "seeded_defect",
        *[F.col("per_year_variable")[F.lit(w)].alias(f"variable_{w}") for w in (EARLY, MIDDLE, LATE)],
        *[F.col("values_pct")[F.lit(w)].alias(f"value_{w}") for w in (EARLY, MIDDLE, LATE)])


@query
def malformed_claims(spark, sf_dir):
    """Claims written from parts, of which some are cut off, mistyped or no object: the values read and the lines reported."""
    key = F.col("p_partkey").cast("string")
    whole = F.concat(F.lit('{"id": "P'), key, F.lit('", "variable": "part", "claim": {"value": '), F.col("p_size").cast("string"), F.lit("}}"))
    kind = F.col("p_partkey") % 7
    line = (F.when(kind == 1, F.concat(F.lit('{"id": "P'), key, F.lit('", "vari')))
            .when(kind == 2, F.concat(F.lit('{"id": "P'), key, F.lit('", "claim": {"value": "much"}}')))
            .when(kind == 3, F.concat(F.lit('["P'), key, F.lit('"]'))).otherwise(whole))
    path = f"{scratch_dir(spark)}/lines"
    spark.read.parquet(f"{sf_dir}/part.parquet").select(line.alias("value")).write.text(path)
    read = CL.load_claims(spark, path).select("id", F.lit("read").alias("status"), "claimed")
    return read.unionByName(CL.malformed_records(spark, path).select(
        F.regexp_extract("line", r"P\d+", 0).alias("id"), F.lit("malformed").alias("status"), F.lit(None).cast("double").alias("claimed")))


@query
def load_variables(spark, sf_dir):
    """The metadata table against the data: substantive, reserved and missing answers per column."""
    names = [v.name for v in CATALOG] + ["quarter"]
    counts = (
        micro(spark, sf_dir).select(*names).unpivot([], names, "variable", "v").groupBy("variable", "v")
        .agg(F.count("*").alias("n"))
    )
    meta = CATALOG.as_frame(spark)
    unknown = unknown_variables(counts.select("variable").distinct(), meta).withColumn("unknown", F.lit(True))
    valid = F.array_contains("valid_codes", F.col("v"))
    return (
        counts.join(meta, "variable", "left").join(unknown, "variable", "left").groupBy("variable").agg(
            F.max(F.coalesce("unknown", F.lit(False))).alias("is_unknown"),
            F.max(F.size("valid_codes")).alias("codes"),
            F.sum(F.when(valid, F.col("n"))).alias("substantive"),
            F.sum(F.when(~valid, F.col("n"))).alias("reserved"),
            F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("missing"),
        )
    )


@query
def load_wave_variables(spark, sf_dir):
    answers = TR.value_table(wave_frames(spark, sf_dir), WAVES).groupBy("canonical", "wave").agg(
        F.sum("answers").alias("answers"))
    return WAVES.as_frame(spark).join(answers, ["canonical", "wave"], "left").select(
        "canonical", "wave", "variable", "weight", "encoding", F.size("valid_codes").alias("codes"), "answers")


@query
def publish_bundle(spark, sf_dir):
    """The whole chain: claims, verification, documents, both zones written and read back."""
    bundle = republish(spark, sf_dir)
    held = bundle.snapshot.table("quarantine")
    return bundle.docs.select("id", F.lit("published").alias("zone"), "verdict").unionByName(
        held.select("id", F.lit("quarantine").alias("zone"), "verdict"))


@query
def audit_log(spark, sf_dir):
    """The log of a compile; malformed lines counted over all files, and whether the time of the run lies between the data and now."""
    bundle = published(spark, sf_dir)
    log = bundle.snapshot.table("audit")
    files = log.where("section = 'malformed'")
    lines = files.agg(F.coalesce(F.sum(F.regexp_extract("note", r"^\d+", 0).cast("bigint")), F.lit(0)).alias("lines"), F.max("run_at").alias("run_at"))
    dash = [F.lit("-").alias(c) for c in ("claimed", "right_value", "delta")]
    unread = lines.select(F.lit("malformed").alias("section"), F.lit("all files").alias("id"), F.lit("UNREAD").alias("verdict"), *dash,
                          F.format_string("%d lines are no claims", "lines").alias("note"), "run_at")
    run = F.to_timestamp("run_at")
    timed = (run > F.to_timestamp(F.lit(data_stamp(spark, sf_dir)))) & (run <= F.current_timestamp())
    return log.where("section != 'malformed'").unionByName(unread).withColumn("run_at", timed).withColumnRenamed("run_at", "timed")


@query
def scan_bundle(spark, sf_dir):
    bundle = published(spark, sf_dir)
    parsed = D.parse_documents(D.raw_documents(B.scan_bundle(spark, bundle.snapshot.path)))
    return parsed.select("id", "title", "type", "variable", "value", F.length("body").alias("body_length"))


# --- filters and projections -------------------------------------------------------------------------------


@query
def filter_universe(spark, sf_dir):
    data = micro(spark, sf_dir)
    return tidy(data.where(P.universe_filter(data, MIXED)).groupBy("yr").agg(
        F.count("*").alias("n"), F.sum("wt").alias("sum_wt")))


@query
def validate_universe(spark, sf_dir):
    """Which predicate texts are accepted, and how many rows those hold: one scan for all."""
    data = micro(spark, sf_dir)
    counted, refused = [], []
    for i, probe in enumerate(PROBES):
        try:
            P.validate_universe(probe, data.columns)
        except ValueError:
            refused.append((i, False))
        else:
            counted.append(F.struct(
                F.lit(i).alias("probe"), F.lit(True).alias("accepted"),
                F.count_if(P.universe_filter(data, probe)).alias("n")))
    accepted = data.agg(F.array(*counted).alias("found")).select(F.inline("found"))
    rejected = spark.createDataFrame(refused, "probe int, accepted boolean").withColumn(
        "n", F.lit(None).cast("bigint"))
    return accepted.unionByName(rejected)


@query
def filter_valid_codes(spark, sf_dir):
    data = micro(spark, sf_dir)
    return data.where(P.in_codes(data, "wait", CATALOG["wait"].valid)).groupBy("yr").agg(
        F.count("*").alias("n"), F.sum("wait").alias("wait_total"))


@query
def substantive_rows(spark, sf_dir):
    rows = E.substantive(micro(spark, sf_dir), "refund", MAY_CLAIM, CATALOG["refund"].valid)
    return tidy(rows.groupBy("refund").agg(F.count("*").alias("n"), F.sum("wt").alias("sum_wt")))


@query
def affirmative_flag(spark, sf_dir):
    data = micro(spark, sf_dir)
    flag = P.as_flag(P.in_codes(data, "refund", CATALOG["refund"].affirmative))
    return tidy(data.select("yr", flag.alias("flag")).groupBy("yr").agg(
        F.sum("flag").alias("sum_flag"), F.avg("flag").alias("share")))


@query
def threshold_flag(spark, sf_dir):
    data = micro(spark, sf_dir)
    rows = E.substantive(data, "wait", SENT_BACK, CATALOG["wait"].valid).where("wt IS NOT NULL")
    flag = P.threshold_flag(F.col("wait"), F.lit(20.0))
    return tidy(rows.select("quarter", "wt", flag.alias("flag")).groupBy("quarter").agg(
        F.sum("flag").alias("sum_flag"), (F.sum(F.col("wt") * F.col("flag")) / F.sum("wt")).alias("share")))


@query
def drop_reserved_codes(spark, sf_dir):
    return TB.drop_reserved_codes(micro(spark, sf_dir), "wait").groupBy("wait").agg(F.count("*").alias("n"))


@query
def integer_like_only(spark, sf_dir):
    data = micro(spark, sf_dir)
    return tidy(data.where(P.integer_like(data, "wt")).groupBy("yr").agg(
        F.count("*").alias("n"), F.sum("wt").alias("sum_wt")))


@query
def rows_inspect(spark, sf_dir):
    columns = ["resp_id", "wait", "wt", "quarter"]
    return RW.inspect_rows(micro(spark, sf_dir), columns, universe=SENT_BACK, limit=25,
                           order_by=["resp_id", "wt", "wait", "quarter"])


@query
def rows_with_column_summary(spark, sf_dir):
    allowed = D.verified_variables(published(spark, sf_dir).docs)
    return RW.rows_with_meanings(micro(spark, sf_dir), INSPECTED, CATALOG, allowed, universe=SENT_BACK, limit=25,
                                 order_by=["refund", "quarter", "wait", "spend"])


# --- estimates ---------------------------------------------------------------------------------------------


def _share(spark, sf_dir, **changes):
    settings = dict(universe=PAID_BACK, affirmative=(1, 2), valid=(0, 1, 2), design=DESIGN) | changes
    return tidy(E.prevalence(micro(spark, sf_dir), "refund", **settings))


@query
def prevalence_weighted(spark, sf_dir):
    return _share(spark, sf_dir)


@query
def prevalence_unweighted(spark, sf_dir):
    return _share(spark, sf_dir, weighted=False)


@query
def prevalence_all_in_universe(spark, sf_dir):
    return _share(spark, sf_dir, universe=None, weighted=False, denominator="all_in_universe")


@query
def prevalence_registry(spark, sf_dir):
    return tidy(survey(spark, sf_dir).prevalence("refund"))


@query
def mean_weighted(spark, sf_dir):
    return tidy(E.mean(micro(spark, sf_dir), "spend", universe="quarter == 2", valid=CATALOG["spend"].valid,
                       design=DESIGN))


@query
def mean_unweighted(spark, sf_dir):
    return tidy(E.mean(micro(spark, sf_dir), "spend", universe="quarter == 2", valid=CATALOG["spend"].valid,
                       design=DESIGN, weighted=False))


@query
def mean_registry(spark, sf_dir):
    return tidy(survey(spark, sf_dir).mean("cut"))


@query
def quantile_weighted(spark, sf_dir):
    return tidy(Q.quantile(micro(spark, sf_dir), "spend", 0.37, universe="quarter == 2", valid=CATALOG["spend"].valid,
                           design=DESIGN))


@query
def quantile_unweighted(spark, sf_dir):
    return tidy(Q.quantile(micro(spark, sf_dir), "spend", 0.37, universe="quarter == 2", valid=CATALOG["spend"].valid,
                           design=DESIGN, weighted=False))


@query
def quantile_registry(spark, sf_dir):
    return tidy(survey(spark, sf_dir).quantile("wait", 0.9))


@query
def ci_prevalence(spark, sf_dir):
    return tidy(E.prevalence_ci(micro(spark, sf_dir), "refund", universe=PAID_BACK, affirmative=(1, 2), valid=(0, 1, 2),
                                design=DESIGN))


@query
def design_effect(spark, sf_dir):
    """Design effect of one share per wave."""
    return tidy(E.prevalence_ci(micro(spark, sf_dir), "paid", universe=None, affirmative=(1,), valid=(0, 1),
                                design=DESIGN, by=("yr",)).select("yr", "estimate", "deff"))


@query
def design_counts(spark, sf_dir):
    return tidy(E.mean_ci(micro(spark, sf_dir), "cut", universe="quarter == 1", valid=CATALOG["cut"].valid,
                          design=DESIGN, by=("yr",)).select("yr", "n", "n_psu", "n_strata", "denominator_weighted"))


@query
def ci_prevalence_registry(spark, sf_dir):
    return tidy(survey(spark, sf_dir).prevalence_ci("refund"))


@query
def psu_variance(spark, sf_dir):
    rows = E.measured(micro(spark, sf_dir), "spend", universe=None, valid=CATALOG["spend"].valid, design=DESIGN)
    return tidy(E.psu_variance(rows))


@query
def ci_mean(spark, sf_dir):
    return tidy(E.mean_ci(micro(spark, sf_dir), "wait", universe=SENT_BACK, valid=CATALOG["wait"].valid, design=DESIGN))


@query
def ci_quantile(spark, sf_dir):
    return tidy(Q.quantile_ci(micro(spark, sf_dir), "spend", 0.37, universe=None, valid=CATALOG["spend"].valid,
                              design=DESIGN))


@query
def ci_srs(spark, sf_dir):
    found = E.prevalence_ci(micro(spark, sf_dir), "refund", universe=PAID_BACK, affirmative=(1, 2), valid=(0, 1, 2),
                            design=DESIGN)
    return tidy(found.select(
        "srs_half_width", ((F.col("uci") - F.col("lci")) / 2).alias("design_half_width")))


@query
def subpopulation_stat(spark, sf_dir):
    found = survey(spark, sf_dir).subpopulation("refund", "outcome == 3 & quarter == 2")
    return tidy(found).withColumn("line", TB.estimate_text())


# --- tables ------------------------------------------------------------------------------------------------


@query
def table_prevalence_by(spark, sf_dir):
    return tidy(survey(spark, sf_dir).table("refund", "quarter", universe=SENT_BACK))


@query
def table_mean_by(spark, sf_dir):
    return tidy(survey(spark, sf_dir).table("spend", "cut", "mean"))


@query
def table_quantile_by(spark, sf_dir):
    return tidy(survey(spark, sf_dir).table("spend", "outcome", "quantile", 0.37))


@query
def group_values(spark, sf_dir):
    data = micro(spark, sf_dir)
    return TB.group_values(data, "cut", CATALOG).withColumn("column", F.lit("cut")).unionByName(
        TB.group_values(data, "yr", CATALOG).withColumn("column", F.lit("yr")))


@query
def group_cap(spark, sf_dir):
    data = micro(spark, sf_dir)
    parts = [TB.group_count(data, c, CATALOG, cap=20).withColumn("column", F.lit(c)) for c in ("quarter", "qty")]
    return parts[0].unionByName(parts[1])


@query
def table_text(spark, sf_dir):
    return TB.table_text(survey(spark, sf_dir).table("wait", "quarter", "mean", universe=SENT_BACK))


# --- waves -------------------------------------------------------------------------------------------------


@query
def trend_prevalence(spark, sf_dir):
    return tidy(TR.trend_prevalence(wave_frames(spark, sf_dir), "sent_back", WAVES))


@query
def partition_waves(spark, sf_dir):
    """The shares of all waves from one scan of their copy partitioned by wave."""
    waves = M.partition_waves(wave_frames(spark, sf_dir), f"{scratch_dir(spark)}/waves")
    return tidy(TR.trend_prevalence(waves, "sent_back", WAVES))


@query
def rename_gap(spark, sf_dir):
    return TR.rename_gap(C.trend_claims(spark, sf_dir), wave_frames(spark, sf_dir), WAVES)


@query
def empirical_domain(spark, sf_dir):
    return tidy(TR.empirical_domain(wave_frames(spark, sf_dir), WAVES))


@query
def encoding_guard(spark, sf_dir):
    domains = TR.empirical_domain(wave_frames(spark, sf_dir), WAVES)
    return tidy(TR.encoding_guard(C.trend_claims(spark, sf_dir), domains))


@query
def verify_trend(spark, sf_dir):
    found = TR.verify_trends(C.trend_claims(spark, sf_dir), wave_frames(spark, sf_dir), WAVES)
    return found.select(
        "id", "verdict", "lint_ok", "caught", joined("diagnosis"),
        *[F.col("right_values")[F.lit(w)].alias(f"right_{w}") for w in (EARLY, MIDDLE, LATE)])


@query
def trend_years_available(spark, sf_dir):
    """Can trends be published: with all waves at hand, and with the last one only. And how many claims wait for a missing wave."""
    stated, waves = C.trend_claims(spark, sf_dir), wave_frames(spark, sf_dir)
    years = stated.select("id", F.explode("years").alias("year"))
    parts = []
    for name, have in (("all", waves), ("last only", {LATE: waves[LATE]})):
        waiting = TR.waves_missing(stated, have).join(years, "year").agg(
            F.count_distinct("year").alias("missing"), F.count_distinct("id").alias("waiting"))
        parts.append(waiting.select("missing", (F.col("missing") == 0).alias("available"), "waiting", F.lit(name).alias("waves")))
    return parts[0].unionByName(parts[1])


# --- claims ------------------------------------------------------------------------------------------------


@query
def lint_claims(spark, sf_dir):
    found = V.lint_claims(C.claims(spark, sf_dir), CATALOG)
    return found.select("id", "lint_ok", joined("lint_messages"))


def _verdict_columns():
    return ["id", "verdict", "claimed", "right_value", "delta", joined("diagnosis"), "detail"]


@query
def verify_prevalence_claims(spark, sf_dir):
    stated = C.claims(spark, sf_dir).where((F.col("kind") == "prevalence") & F.col("claimed").isNotNull())
    found = V.verify_claims(micro(spark, sf_dir), stated, CATALOG, DESIGN)
    return tidy(found.select(*_verdict_columns(), "lci", "uci", "se", "deff"))


@query
def verify_continuous_claims(spark, sf_dir):
    stated = C.claims(spark, sf_dir).where(F.col("kind") != "prevalence")
    found = V.verify_claims(micro(spark, sf_dir), stated, CATALOG, DESIGN)
    return found.select(*_verdict_columns())


@query
def verify_all_claims(spark, sf_dir):
    found = V.verify_claims(micro(spark, sf_dir), C.claims(spark, sf_dir), CATALOG, DESIGN)
    return found.select("id", "verdict", "lint_ok", "caught", "claimed", "right_value", "delta", joined("diagnosis"))


@query
def batch_estimate(spark, sf_dir):
    """All estimates the claims need, with both flawed variants, from one scan."""
    found = batch_estimates(micro(spark, sf_dir), C.DOMAINS, CATALOG, DESIGN)
    return tidy(found.withColumn("retained_codes", F.array_join(F.col("retained_codes").cast("array<string>"), ", ")))


@query
def diagnose_method(spark, sf_dir):
    stated = V.with_method(C.claims(spark, sf_dir), CATALOG).where(F.col("claimed").isNotNull())
    return stated.select("id", F.array_join(V.diagnose_method(), "; ").alias("diagnosis"))


def _with_estimates(bundle):
    return V.with_estimates(bundle.claims, bundle.estimates, CATALOG, "inner").where(F.col("claimed").isNotNull())


@query
def ci_precision_check(spark, sf_dir):
    rows = _with_estimates(published(spark, sf_dir)).where(F.col("claimed_low").isNotNull())
    return tidy(rows.select(
        "id", ((F.col("claimed_high") - F.col("claimed_low")) / 2).alias("claimed_half"),
        ((F.col("uci") - F.col("lci")) / 2).alias("design_half"),
        F.array_join(V.ci_precision_check(), "; ").alias("diagnosis")))


@query
def diagnose_continuous(spark, sf_dir):
    rows = _with_estimates(published(spark, sf_dir)).where(F.col("kind") != "prevalence")
    off = F.abs(F.col("claimed") - F.col("estimate")) > F.col("tolerance")
    return rows.select(
        "id", F.when(off, V.closest_variant()).alias("variant"),
        F.when(off, F.array_join(V.diagnose_continuous(), "; ")).otherwise("").alias("diagnosis"))


@query
def closest_variant(spark, sf_dir):
    rows = _with_estimates(published(spark, sf_dir)).where(F.col("kind") != "prevalence")
    return tidy(rows.select("id", "claimed", "estimate", "unweighted", "reserved_kept",
                            V.closest_variant().alias("variant")))


@query
def observed_codes(spark, sf_dir):
    """All codes that occur per continuous column, and those outside the valid ones."""
    names = ["wait", "cut", "spend"]
    codes = micro(spark, sf_dir).select(*names).unpivot([], names, "variable", "v").where(F.col("v").isNotNull())
    seen = codes.distinct().groupBy("variable").agg(F.array_sort(F.collect_set("v")).alias("observed"))
    meta = CATALOG.as_frame(spark).select("variable", "valid_codes")
    return seen.join(meta, "variable").select(
        "variable", joined("observed", ","),
        F.array_join(F.array_except("observed", "valid_codes").cast("array<string>"), ",").alias("retained"))


@query
def code_counts(spark, sf_dir):
    """Every code of five columns with its rows, valid or not."""
    return RW.code_counts(micro(spark, sf_dir), ["outcome", "refund", "wait", "cut", "spend"], CATALOG)


@query
def caught_count(spark, sf_dir):
    return V.caught_count(published(spark, sf_dir).verdicts)


@query
def compile_invariant(spark, sf_dir):
    bundle = published(spark, sf_dir)
    both = bundle.verdicts.select("seeded_defect", "verdict").unionByName(
        bundle.trend_verdicts.select("seeded_defect", "verdict"))
    return V.compile_invariant(both)


@query
def seeded_defect_catch(spark, sf_dir):
    bundle = published(spark, sf_dir)
    columns = ["id", "verdict", "lint_ok", "caught", joined("diagnosis")]
    return bundle.verdicts.where("seeded_defect").select(*columns).unionByName(
        bundle.trend_verdicts.where("seeded_defect").select(*columns))


# --- documents ---------------------------------------------------------------------------------------------


@query
def render_concept_docs(spark, sf_dir):
    docs = published(spark, sf_dir).docs.where(F.col("type") != "metric")
    return docs.select("id", "title", "description", joined("tags", ","), "value", "unit", "front_matter", "body")


@query
def render_trend_docs(spark, sf_dir):
    docs = published(spark, sf_dir).docs.where(F.col("type") == "metric")
    return docs.select("id", "title", "description", joined("tags", ","), "front_matter", "body")


@query
def reproduce_spec(spark, sf_dir):
    spec = D.reproduce_spec(published(spark, sf_dir).claims, CATALOG)
    return spec.select("id", "variable", "universe", "stat", "q", joined("columns", ","), "estimate_call", "rows_call")


@query
def bundle_index(spark, sf_dir):
    return D.bundle_index(published(spark, sf_dir).docs)


def _with_broken(spark, sf_dir):
    """The published texts next to damaged copies of them."""
    raw = D.raw_documents(published(spark, sf_dir).docs)
    broken = raw.select(F.concat("id", F.lit("_bare")).alias("id"), F.regexp_replace("raw", "^---\n", "").alias("raw"))
    untyped = raw.select(F.concat("id", F.lit("_untyped")).alias("id"),
                         F.regexp_replace("raw", "(?m)^type: .*$", "type:").alias("raw"))
    return raw.unionByName(broken).unionByName(untyped)


@query
def conformance_check(spark, sf_dir):
    return D.conformance_issues(_with_broken(spark, sf_dir))


@query
def dangling_links(spark, sf_dir):
    return D.dangling_links(published(spark, sf_dir).docs)


@query
def quarantine_leak_check(spark, sf_dir):
    """Leaks in the bundle (none), and in a bundle where each quarantined text was added on purpose."""
    bundle = published(spark, sf_dir)
    leaky = bundle.verdicts.where((F.col("verdict") == "FAIL") & F.col("claimed").isNotNull()).select(
        F.concat("id", F.lit("_leak")).alias("id"), F.lit("").alias("front_matter"),
        F.concat(F.lit("About "), X.number_text(F.col("claimed")), F.lit("%.")).alias("body"))
    docs = bundle.docs.select("id", "front_matter", "body").unionByName(leaky)
    return D.quarantine_leaks(docs, bundle.verdicts)


@query
def verified_variables(spark, sf_dir):
    return D.verified_variables(published(spark, sf_dir).docs)


REQUESTS = [
    ("r1", "refund", "outcome == 3 & quarter == 2", "prevalence", None),
    ("r2", "quarter", None, "mean", None),
    ("r3", "refund", "outcome == 999", "prevalence", None),
    ("r4", "wait", "outcome + 1 == 3", "mean", None),
    ("r5", "spend", None, "quantile", 0.6),
    ("r6", "wait", None, "mode", None),
    ("r7", "cut", "quarter == 1", "mean", None),
    ("r8", "wait", SENT_BACK, "quantile", None),
]


@query
def grounded_or_refuse(spark, sf_dir):
    asked = spark.createDataFrame(REQUESTS, R.REQUEST_SCHEMA)
    allowed = D.verified_variables(published(spark, sf_dir).docs)
    return tidy(R.grounded_or_refuse(micro(spark, sf_dir), asked, allowed, CATALOG, DESIGN))


@query
def grounded_table(spark, sf_dir):
    """A table by a column of 50 values, for a published variable."""
    allowed = D.verified_variables(published(spark, sf_dir).docs)
    found = R.grounded_table(micro(spark, sf_dir), allowed, "wait", "qty", catalog=CATALOG, design=DESIGN, stat="mean", universe=SENT_BACK)
    return tidy(found.select("group_value", "estimate", "se", "lci", "uci", "n"))


TABLE_REQUESTS = [
    ("t1", "refund", SENT_BACK, "prevalence", None, "quarter"),
    ("t2", "wait", SENT_BACK, "mean", None, "qty"),
    ("t3", "spend", "quarter == 1 | qty > 25", "mean", None, "stratum"),
    ("t4", "cut", None, "mean", None, "outcome"),
    ("t5", "spend", "qty <= 10", "quantile", None, "cluster"),
    ("t6", "cut", None, "mean", None, None),
    ("t7", "spend", None, "mean", None, "no_column"),
    ("t8", "wait", "outcome == 999", "mean", None, "qty"),
    ("t9", "quarter", None, "mean", None, "qty"),
]


@query
def grounded_tables(spark, sf_dir):
    """Tables by five grouping columns and a single figure, refusals among them, from one scan."""
    asked = spark.createDataFrame(TABLE_REQUESTS, R.TABLE_REQUEST_SCHEMA)
    allowed = D.verified_variables(published(spark, sf_dir).docs)
    return tidy(R.grounded_tables(micro(spark, sf_dir), asked, allowed, CATALOG, DESIGN))


# --- search ------------------------------------------------------------------------------------------------


@query
def tfidf_index(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tidy(S.tfidf_index(docs, "doc_id", "text").postings.drop("block"))


@query
def tfidf_topk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    index = S.write_index(S.tfidf_index(docs, "doc_id", "text"))
    return tidy(S.tfidf_topk(index, asked, query_key="item_id", text="text", k=3))


def _hits(spark, sf_dir):
    return S.search_documents(published(spark, sf_dir).docs, questions(spark))


@query
def search_published(spark, sf_dir):
    return tidy(_hits(spark, sf_dir).select("question_id", "id", "rank", "score"))


@query
def search_results_text(spark, sf_dir):
    return S.search_results_text(_hits(spark, sf_dir), questions(spark))


@query
def answer_extractive(spark, sf_dir):
    return S.answer_extractive(_hits(spark, sf_dir), questions(spark))


# --- building blocks with a check of their own -------------------------------------------------------------


@query
def running_weight(spark, sf_dir):
    data = micro(spark, sf_dir)
    rows = E.measured(data, "spend", universe=None, valid=CATALOG["spend"].valid, design=DESIGN, by=("yr",))
    runs = Q.value_runs(Q.value_cells(rows, ["yr"]), ["yr"])
    return tidy(Q.running_weight(runs, ["yr"], CATALOG["spend"].valid).select("yr", "y", "s", "c_s", "total_s"))


@query
def interp_lookup(spark, sf_dir):
    data = micro(spark, sf_dir)
    rows = E.measured(data, "spend", universe=None, valid=CATALOG["spend"].valid, design=DESIGN, by=("yr",))
    marks = Q.knots(Q.value_runs(Q.value_cells(rows, ["yr"]), ["yr"]), ["yr"], CATALOG["spend"].valid)
    return tidy(marks.groupBy("yr").agg(
        *[Q.interpolate(Q.number_sql(q)).alias(f"at_{int(q * 100)}") for q in LOOKUPS]))


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query
def wikilink_to_markdown(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    text = F.concat(F.lit("See [[D"), F.col("doc_id"), F.lit("]] and [[no link]]. "), "text")
    return docs.select("doc_id", F.md5(X.wikilink_to_markdown(text)).alias("digest"))


@query
def frontmatter_split(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    header = F.concat(F.lit('---\ntype: note\nid: D'), F.col("doc_id"), F.lit('\ntitle: "T"\n---\n'))
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(header, "text"))
    parsed = D.parse_documents(docs.select(F.col("doc_id").cast("string").alias("id"), raw.alias("raw")))
    return parsed.select("id", "title", "type", F.md5("body").alias("digest"))


@query
def first_sentence(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(X.one_line(X.first_sentence(F.col("text")))).alias("digest"))


@query
def number_text(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.col("o_totalprice")
    return orders.select("o_orderkey", X.number_text(price).alias("fixed"), X.thousands_text(price).alias("grouped"))


@query
def year_map_text(spark, sf_dir):
    """Mean discount per year as one text per quarter."""
    yearly = micro(spark, sf_dir).groupBy("quarter", "yr").agg(F.avg("cut").alias("mean"))
    maps = yearly.groupBy("quarter").agg(F.map_from_entries(F.collect_list(F.struct("yr", "mean"))).alias("years"))
    return maps.select("quarter", X.year_map_text(F.col("years")).alias("years"))


@query
def codes_text(spark, sf_dir):
    """The codes that occur in a short and in a long code list, per quarter."""
    data = micro(spark, sf_dir)
    sets = data.groupBy("quarter").agg(
        F.array_sort(F.collect_set("outcome")).alias("short"), F.collect_set("qty").alias("long"))
    return sets.select("quarter", X.codes_text(F.col("short")).alias("short"), X.codes_text(F.col("long")).alias("long"))
