"""Claims about the deliveries, with figures taken from right and from flawed methods.

A few claims stand for the whole survey. Beside them every supplier reports one figure of one year and one trend, so claims grow with the
tables. Figures are computed from the data at hand; which supplier reports what, and with which flaw, follows from its number.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import Domain, batch_estimates
from ..operators.trends import trend_prevalence
from ..operators.verify import CI_SLACK
from ..session import shared_dir
from ..sources.claims import load_claims, load_trend_claims
from ..sources.microdata import last_modified
from .micro import CATALOG, DESIGN, EARLY, LATE, MAY_CLAIM, MIDDLE, PAID_BACK, SENT_BACK, WAVES, micro, wave_frames

YEARS = tuple(range(1995, 2002))


@dataclass(frozen=True)
class Spec:
    """A claim as its author words it. ``source`` and ``figure`` say where its number comes from, ``shift`` what is added to it, ``width``
    the part of the right interval that it states. In reports of suppliers the year is added to universes, label and source."""

    id: str
    variable: str
    label: str
    universe: str | None
    seeded: bool
    link: str | None
    prose: str
    statistic: str | None = None
    kind: str | None = None
    q: float | None = None
    unit: str | None = None
    method: str | None = None
    weighted: bool | None = None
    tolerance: float | None = None
    source: str | None = None
    figure: str | None = None
    shift: float = 0.0
    width: float | None = None


SPEC_SCHEMA = (
    "id string, variable string, label string, universe string, seeded boolean, link string, prose string, statistic string, "
    "kind string, q double, unit string, method string, weighted boolean, tolerance double, source string, figure string, shift double, "
    "width double"
)
NAIVE = "naive"  # refunds among all lines, no weights


def _spec(cid, domain: Domain, label, statistic, *, seeded=False, link=None, prose=None, unit=None, tolerance=0.3, figure="estimate",
          weighted=True, method=..., asked=..., source=None, **more) -> Spec:
    return Spec(
        cid, domain.variable, label, domain.universe if asked is ... else asked, seeded, link, f"{label}." if prose is None else prose,
        statistic, domain.kind, domain.q, unit, domain.universe if method is ... else method, weighted, tolerance, source or domain.key, figure, **more)


SHARE_BACK = Domain("outcome", None, "prevalence")
REFUNDED = Domain("refund", PAID_BACK, "prevalence")
REFUNDED_ASKED = Domain("refund", MAY_CLAIM, "prevalence")
WAIT_MEAN = Domain("wait", SENT_BACK, "mean")
WAIT_MEDIAN = Domain("wait", SENT_BACK, "quantile", 0.5)
SPEND_MEAN = Domain("spend", None, "mean")
SPEND_LOW = Domain("spend", None, "quantile", 0.25)
CUT_MEAN = Domain("cut", None, "mean")
CUT_DEEP = Domain("cut", None, "prevalence")
PAID_SHARE = Domain("paid", None, "prevalence")

SPECS = [
    _spec("sent_back", SHARE_BACK, "Goods sent back", "Weighted share of lines sent back", width=1.0, link="refunded",
          prose="Share of all lines whose goods were sent back. Whether money was returned is in [[refunded]]."),
    Spec("paid_lines", "paid", 'Paid lines, "closed"', None, False, "sent_back",
         "Code 1 is a line that is paid in full. What became of the goods is in [[sent_back]]."),
    _spec("refunded", REFUNDED, "Refunds among goods sent back", "Weighted share refunded among paid goods sent back", unit="%", tolerance=0.5,
          link="sent_back", prose="Some or all money was returned, among paid lines sent back ([[sent_back]])."),
    _spec("refunded_asked", REFUNDED_ASKED, "Refunds among all that may ask", "Weighted share refunded among those that may ask", asked=None,
          unit="%", tolerance=0.5, link="no_such_doc"),
    _spec("wait_mean", WAIT_MEAN, "Mean weeks until settled", "Weighted mean of weeks until a case was settled", unit="weeks", link="sent_back"),
    _spec("wait_median", WAIT_MEDIAN, "Median weeks until settled", "Weighted median of weeks until a case was settled", unit="weeks", link="wait_mean"),
    _spec("spend_mean", SPEND_MEAN, "Mean amount of a line", "Weighted mean amount of a line", unit="thousand"),
    _spec("cut_mean", CUT_MEAN, "Mean discount", "Mean discount of a unit", unit="points", tolerance=0.05),
    _spec("cut_deep", CUT_DEEP, "Deep discounts", "Share of units with a deep discount", unit="%", link="cut_mean"),
    _spec("refunded_whole", REFUNDED, "Refunds, all lines", "Share refunded among paid goods sent back", seeded=True, unit="%", tolerance=0.5,
          method=None, weighted=False, source=NAIVE, link="sent_back"),
    _spec("spend_plain", SPEND_MEAN, "Mean amount, plain average", "Mean amount of a line", seeded=True, unit="thousand", weighted=False,
          figure="unweighted", link="sent_back"),
    _spec("spend_low_plain", SPEND_LOW, "First quartile of amounts, plain", "First quartile of amounts", seeded=True, unit="thousand",
          figure="unweighted", link="spend_mean"),
    _spec("wait_open", WAIT_MEAN, "Mean weeks, open cases kept", "Mean of the weeks column", seeded=True, unit="weeks", figure="reserved_kept"),
    _spec("sent_back_narrow", SHARE_BACK, "Goods sent back, narrow interval", "Weighted share of lines sent back", seeded=True, unit="%", width=0.3,
          link="refunded", prose="The share is right, its interval is not."),
    _spec("paid_off", PAID_SHARE, "A wrong share under the right method", "Weighted share of paid lines", seeded=True, unit="%", shift=4.25,
          link="paid_lines"),
    Spec("cut_blank", "cut", "A record without text", None, True, None, " "),
]

# What a supplier may report: for each figure the sound report and its flawed ones.
REPORTS = [
    [_spec("sent_back", SHARE_BACK, "Goods sent back", "Weighted share of lines sent back", unit="%", **({"link": "sent_back"} | flaw))
     for flaw in (dict(width=1.0), dict(shift=-3.5, seeded=True), dict(width=0.3, seeded=True), dict(link="no_such_doc"))],
    [_spec("refunded", REFUNDED, "Refunds among goods sent back", "Weighted share refunded among paid goods sent back", unit="%", tolerance=0.5,
           **({"link": "refunded"} | flaw)) for flaw in ({}, dict(method=None, weighted=False, source=NAIVE, seeded=True))],
    [_spec("wait_mean", WAIT_MEAN, "Mean weeks until settled", "Weighted mean of weeks until a case was settled", unit="weeks", tolerance=0.1,
           **({"link": "wait_mean"} | flaw)) for flaw in (dict(figure="reserved_kept", seeded=True), {}, dict(shift=2.5, seeded=True))],
    [_spec("wait_median", WAIT_MEDIAN, "Median weeks until settled", "Weighted median of weeks until a case was settled", unit="weeks",
           **({"link": "wait_median"} | flaw)) for flaw in ({}, dict(shift=-3.0, seeded=True))],
    [_spec("spend_mean", SPEND_MEAN, "Mean amount of a line", "Weighted mean amount of a line", unit="thousand", **({"link": "spend_mean"} | flaw))
     for flaw in (dict(figure="unweighted", weighted=False, seeded=True), {})],
    [_spec("spend_low", SPEND_LOW, "First quartile of amounts", "Weighted first quartile of amounts", unit="thousand", **({"link": "spend_mean"} | flaw))
     for flaw in ({}, dict(figure="unweighted", seeded=True))],
    [_spec("cut_mean", CUT_MEAN, "Mean discount", "Mean discount of a unit", unit="points", tolerance=0.05, **({"link": "cut_mean"} | flaw))
     for flaw in ({}, dict(shift=0.75, seeded=True), {})],
    [_spec("paid", PAID_SHARE, "Paid lines", "Weighted share of paid lines", unit="%", **({"link": "paid_lines"} | flaw))
     for flaw in ({}, dict(width=0.3, seeded=True), dict(shift=5.5, seeded=True))],
]
for _flaws in REPORTS:
    assert len({s.id for s in _flaws}) == 1


def of_year(universe: str | None, year: int) -> str:
    return f"yr == {year}" if universe is None else f"{universe} & yr == {year}"


BASE_DOMAINS = [SHARE_BACK, REFUNDED, REFUNDED_ASKED, WAIT_MEAN, WAIT_MEDIAN, SPEND_MEAN, SPEND_LOW, CUT_MEAN, CUT_DEEP, PAID_SHARE]
YEAR_DOMAINS = [SHARE_BACK, REFUNDED, WAIT_MEAN, WAIT_MEDIAN, SPEND_MEAN, SPEND_LOW, CUT_MEAN, PAID_SHARE]
DOMAINS = BASE_DOMAINS + [Domain(d.variable, of_year(d.universe, y), d.kind, d.q) for d in YEAR_DOMAINS for y in YEARS]


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("s"))


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims without their numbers: those for the whole survey, and one report per supplier."""
    whole = spark.createDataFrame([astuple(s) for s in SPECS], SPEC_SCHEMA)
    choices = spark.createDataFrame(
        [(i, j, len(flaws), *astuple(s)) for i, flaws in enumerate(REPORTS) for j, s in enumerate(flaws)],
        f"report int, flaw int, flaws int, {SPEC_SCHEMA}")
    s, n = F.col("s"), len(REPORTS)
    reports = _suppliers(spark, sf_dir).withColumn("yr", YEARS[0] + s % len(YEARS)).join(
        choices, (s % n == F.col("report")) & (F.floor(s / n) % F.col("flaws") == F.col("flaw")))
    this_year = F.concat(F.lit("yr == "), "yr")

    def with_year(name: str):
        return F.coalesce(F.concat(name, F.lit(" & "), this_year), this_year)

    naive = F.col("source") == NAIVE
    key = F.concat_ws("|", "kind", "variable", with_year("universe"), F.when(F.col("q").isNull(), "").otherwise(F.format_string("%.6f", "q")))
    return whole.unionByName(reports.select(
        F.concat("id", F.lit("_s"), s).alias("id"), "variable",
        F.concat("label", F.lit(", "), "yr", F.lit(", supplier "), s).alias("label"),
        with_year("universe").alias("universe"), "seeded", "link",
        F.concat(F.lit("Reported by supplier "), s, F.lit(" for "), "yr", F.lit(". Compare [["), F.col("link"), F.lit("]].")).alias("prose"),
        "statistic", "kind", "q", "unit",
        F.when(naive, this_year).otherwise(with_year("method")).alias("method"),
        "weighted", "tolerance",
        F.when(naive, F.concat(F.lit(f"{NAIVE}|"), "yr")).otherwise(key).alias("source"),
        "figure", "shift", "width",
    ))


def claim_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims as their authors would write them: nested, some with the older keys."""
    data = micro(spark, sf_dir)
    kinds = ("estimate", "unweighted", "reserved_kept")
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("value")) for c in kinds]))
    estimates = batch_estimates(data, DOMAINS, CATALOG, DESIGN)
    figures = estimates.select(F.col("domain_key").alias("source"), ((F.col("uci") - F.col("lci")) / 2).alias("half"), each)
    counts = data.groupBy("yr").agg(F.count_if(F.col("refund").isin(1, 2)).alias("yes"), F.count("*").alias("n"))
    per_year = counts.rollup("yr").agg((100 * F.sum("yes") / F.sum("n")).alias("value"), F.grouping("yr").alias("whole"))
    naive = per_year.select(
        F.when(F.col("whole") == 1, NAIVE).otherwise(F.concat(F.lit(f"{NAIVE}|"), "yr")).alias("source"), F.lit(None).cast("double").alias("half"),
        F.lit("estimate").alias("figure"), "value")
    specs = _specs(spark, sf_dir).join(figures.unionByName(naive), ["source", "figure"], "left")
    claimed = F.round(F.col("value") + F.col("shift"), 2)
    old_keys = F.col("kind") == "prevalence"
    around = F.col("value") + F.col("shift")
    reach = F.col("width") * F.col("half")
    interval = F.when(F.col("width").isNotNull(), F.array(F.round(around - reach, 2), F.round(around + reach, 2)))
    # A narrow interval is a defect only where it is narrower by more than the slack of the check.
    shows = F.col("width").isNull() | ((1 - F.col("width")) * F.col("half") > CI_SLACK)
    claim = F.struct(
        "statistic", "kind", F.col("q").alias("quantile_q"), "unit",
        F.struct(F.col("method").alias("universe_expr"), "weighted").alias("method"),
        F.when(~old_keys, claimed).alias("value"), F.when(old_keys, claimed).alias("value_pct"),
        F.when(~old_keys, F.col("tolerance")).alias("tolerance"),
        F.when(old_keys, F.col("tolerance")).alias("tolerance_pct"),
        interval.alias("ci_95"),
    )
    return specs.select(
        "id", "variable", "label", F.col("universe").alias("analytical_universe"),
        (F.col("seeded") & shows).alias("seeded_defect"), F.array_compact(F.array("link")).alias("links"), "prose",
        F.when(F.col("source").isNotNull(), claim).alias("claim"),
    )


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> str:
    """The folder of lines that ``make`` gives for these data, written once per application: authors state their claims once."""
    about = [spark.sparkContext.applicationId, sf_dir, *[last_modified(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier")]]
    path = shared_dir(spark, f"{name}/{hashlib.md5(repr(about).encode()).hexdigest()}")
    if last_modified(spark, f"{path}/whole") is None:  # written last, so a folder that is not whole is made anew
        make().write.mode("overwrite").text(f"{path}/lines")
        spark.range(1).coalesce(1).write.mode("overwrite").json(f"{path}/whole")
    return f"{path}/lines"


def claims_path(spark: SparkSession, sf_dir: str) -> str:
    """The claims as JSON lines. The reports of some suppliers arrive a second time, cut off."""
    def lines():
        lost = _suppliers(spark, sf_dir).where("s % 10 = 7")
        whole = claim_records(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
        return whole.unionByName(lost.select(F.concat(F.lit('{"id": "again_s'), "s", F.lit('", "claim": {"val')).alias("value")))

    return _once(spark, sf_dir, "claims", lines)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims, loaded from JSON lines."""
    return load_claims(spark, claims_path(spark, sf_dir))


# Trends that suppliers report: measure, the one column name used for all years (or none), flawed, title, then for every year the column
# that was used, the wave whose figure is stated (or none) and what is added to it.
TRENDS = [
    ("sent_back", None, False, "Goods sent back", [(EARLY, "result", EARLY, 0.0), (MIDDLE, "result", MIDDLE, 0.0), (LATE, "outcome", LATE, 0.0)]),
    ("paid_up", "paid", False, "Paid lines", [(EARLY, "paid", EARLY, 0.0), (LATE, "paid", LATE, 0.0)]),
    ("sent_back", "outcome", True, "Goods sent back, one name", [(EARLY, "outcome", LATE, 0.0), (MIDDLE, "outcome", LATE, 0.0), (LATE, "outcome", LATE, 0.0)]),
    ("discount", None, True, "Mean discount", [(EARLY, "cut_pm", None, 50.5), (MIDDLE, "cut", None, 20.25), (LATE, "cut", None, 5.0)]),
    ("paid_up", "paid", True, "Paid lines, a dip", [(EARLY, "paid", EARLY, 0.0), (MIDDLE, "paid", MIDDLE, -6.5), (LATE, "paid", LATE, 0.0)]),
]
TREND_STATISTIC = "Weighted share in each wave"


def trend_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trend claim per supplier: sound ones, joins by one column name, a measure whose scale changed, a figure that is off."""
    waves = wave_frames(spark, sf_dir)
    shares = [trend_prevalence(waves, m, WAVES).select(F.lit(m).alias("canonical"), F.col("wave").alias("stated"), "value_pct")
              for m in ("sent_back", "paid_up")]
    parts = spark.createDataFrame(
        [(i, *t[:4], place, *part) for i, t in enumerate(TRENDS) for place, part in enumerate(t[4])],
        "report int, canonical string, single string, seeded boolean, title string, place int, year int, used string, stated int, shift double")
    stated = parts.join(shares[0].unionByName(shares[1]), ["canonical", "stated"], "left").withColumn(
        "value", F.round(F.coalesce("value_pct", F.lit(0.0)) + F.col("shift"), 2))
    ordered = F.array_sort(F.collect_list(F.struct("place", "year", "used", "value")))
    reports = stated.groupBy("report", "canonical", "single", "seeded", "title").agg(ordered.alias("parts"))
    keys = F.transform("parts", lambda p: p["year"].cast("string"))
    mapped = F.when(F.col("single").isNull(), F.map_from_arrays(keys, F.transform("parts", lambda p: p["used"])))
    who = _suppliers(spark, sf_dir)
    return who.join(reports, F.col("s") % len(TRENDS) == F.col("report")).select(
        F.concat(F.lit("trend_s"), "s").alias("id"), "canonical",
        F.transform("parts", lambda p: p["year"]).alias("years"),
        F.concat("title", F.lit(", supplier "), "s").alias("title"), F.col("seeded").alias("seeded_defect"),
        F.array(F.lit("sent_back")).alias("links"),
        F.concat(F.lit("Share in several waves by supplier "), "s", F.lit(", see [[sent_back]].")).alias("prose"),
        F.struct(
            F.lit(TREND_STATISTIC).alias("statistic"),
            F.struct(mapped.alias("per_year_variable"), F.col("single").alias("single_variable")).alias("method"),
            F.map_from_arrays(keys, F.transform("parts", lambda p: p["value"])).alias("values_pct"),
            F.lit(0.3).alias("tolerance_pct"),
        ).alias("claim"),
    )


def trend_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _once(spark, sf_dir, "trend_claims", lambda: trend_records(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")))
    return load_trend_claims(spark, path)
