import random
import re

import pytest

from tallyproof import Catalog, Design, Survey, Variable
from tallyproof.operators import estimates as E
from tallyproof.operators import quantiles as Q
from tallyproof.operators import tables as TB
from tallyproof.operators.batch import Domain, batch_estimates, grouped_estimates, join_estimates
from tallyproof.session import written

from . import brute

DESIGN = Design("w", "h", "p")
CATALOG = Catalog([
    Variable("x", "yes or no", None, "all", (1, 2), (1,), "w"),
    Variable("v", "value", "x == 1", "x is yes", range(0, 30), (), "w"),
])
SCHEMA = "x int, v double, g int, w double, h int, p int"


def make_rows(n=400, seed=3):
    """Missing and reserved codes, NaN, missing and zero weights, missing design keys, one single-PSU stratum."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        stratum = rng.choice([1, 2, 3, 4, 5])
        psu = 1 if stratum == 5 else rng.choice([1, 2, 3])
        weight = rng.choice([0.0, None, float("nan")]) if i % 29 == 0 else rng.choice([1.0, 2.5, rng.random() * 9])
        value = rng.choice([None, float("nan"), 97.0, 3.5]) if i % 11 == 0 else float(rng.randrange(0, 30))
        rows.append((rng.choice([1, 1, 2, 2, 7, None]), value, rng.choice([1, 2, 3, 7, None]), weight,
                     None if i % 37 == 0 else stratum, None if i % 41 == 0 else psu))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def valid_v(r):
    return not brute.missing(r[1]) and r[1] == int(r[1]) and 0 <= r[1] < 30


def close(got, want, keys=None):
    for key in keys or want:
        assert got[key] == pytest.approx(want[key], rel=1e-9, abs=1e-12), key


def test_prevalence_ci(data, rows):
    used = [(1.0 if r[0] == 1 else 0.0, r[3], r[4], r[5]) for r in rows if r[0] in (1, 2)]
    want = brute.ratio_ci(used)
    got = E.prevalence_ci(data, "x", universe=None, affirmative=(1,), valid=(1, 2), design=DESIGN).first()
    close(got, {k: v * (100 if k in ("estimate", "se", "lci", "uci") else 1) for k, v in want.items()})
    r = want["estimate"]
    assert got["deff"] == pytest.approx(want["se"] ** 2 / (r * (1 - r) / want["n"]))
    assert got["n_dropped_weight"] == sum(brute.missing(u[1]) for u in used) > 0
    assert got["n_dropped_design"] > 0
    plain = E.prevalence(data, "x", universe=None, affirmative=(1,), valid=(1, 2), design=DESIGN).first()
    assert plain["value_pct"] == pytest.approx(got["estimate"])


def test_mean_ci_in_a_universe(data, rows):
    used = [(r[1], r[3], r[4], r[5]) for r in rows if r[0] == 1 and valid_v(r)]
    got = E.mean_ci(data, "v", universe="x == 1", valid=range(0, 30), design=DESIGN).first()
    close(got, brute.ratio_ci(used))


def test_singleton_stratum_adds_nothing(spark):
    data = spark.createDataFrame([(1, 1.0, 1, 2.0, 1, 1), (2, 2.0, 1, 3.0, 1, 1)], SCHEMA)
    got = E.mean_ci(data, "v", universe=None, valid=range(0, 30), design=DESIGN).first()
    assert (got["se"], got["n_psu"], got["n_strata"]) == (0.0, 1, 1)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.37, 0.5, 0.9, 1.0])
def test_quantile(data, rows, q):
    used = [(r[1], r[3], r[4], r[5]) for r in rows if valid_v(r)]
    got = Q.quantile(data, "v", q, universe=None, valid=range(0, 30), design=DESIGN).first()
    assert got["value"] == pytest.approx(brute.quantile(used, q), abs=1e-9)
    assert got["n"] == sum(not brute.missing(u[1]) for u in used)


def test_unweighted_quantile(data, rows):
    used = [(r[1], 1.0) for r in rows if valid_v(r)]
    got = Q.quantile(data, "v", 0.37, universe=None, valid=range(0, 30), design=DESIGN, weighted=False).first()
    assert got["value"] == pytest.approx(brute.quantile(used, 0.37), abs=1e-9)


@pytest.mark.parametrize("buckets", [1, 5, 1024])
def test_woodruff(data, rows, buckets, monkeypatch):
    """The running sum does not depend on how the value range is cut."""
    monkeypatch.setattr(Q, "_BUCKETS", buckets)
    used = [(r[1], r[3], r[4], r[5]) for r in rows if valid_v(r)]
    got = Q.quantile_ci(data, "v", 0.37, universe=None, valid=range(0, 30), design=DESIGN).first()
    close(got, brute.quantile_ci(used, 0.37))


def test_woodruff_by_group(data, rows):
    found = Q.quantile_ci(data.where("g in (1, 2)"), "v", 0.6, universe=None, valid=range(0, 30), design=DESIGN,
                          by=("g",)).collect()
    assert len(found) == 2
    for got in found:
        used = [(r[1], r[3], r[4], r[5]) for r in rows if valid_v(r) and r[2] == got["g"]]
        close(got, brute.quantile_ci(used, 0.6))


def test_empty_universe(data):
    settings = dict(universe="x == 55", design=DESIGN)
    got = E.prevalence(data, "x", affirmative=(1,), valid=(1, 2), **settings).first()
    assert (got["value_pct"], got["n_denominator"], got["denominator_weighted"]) == (0.0, 0, 0.0)
    assert E.mean(data, "v", valid=range(0, 30), **settings).first()["value"] == 0.0
    assert Q.quantile(data, "v", 0.5, valid=range(0, 30), **settings).first()["value"] == 0.0
    interval = E.mean_ci(data, "v", valid=range(0, 30), **settings).first()
    assert interval["n"] == 0 and interval["se"] is None
    interval = Q.quantile_ci(data, "v", 0.5, valid=range(0, 30), **settings).first()
    assert interval["n"] == 0 and interval["estimate"] is None


def test_denominators(data, rows):
    got = E.prevalence(data, "x", universe=None, affirmative=(1,), valid=(1, 2), design=DESIGN, weighted=False,
                       denominator="all_in_universe").first()
    assert got["n_denominator"] == len(rows)
    assert got["value_pct"] == pytest.approx(100 * sum(r[0] == 1 for r in rows) / len(rows))
    with pytest.raises(ValueError, match="denominator"):
        E.prevalence(data, "x", universe=None, affirmative=(1,), valid=(1, 2), design=DESIGN, denominator="odd")


def test_deff_of_a_constant_is_null(spark):
    data = spark.createDataFrame([(1, 1.0, 1, 2.0, 1, 1), (1, 2.0, 1, 3.0, 1, 2)], SCHEMA)
    got = E.prevalence_ci(data, "x", universe=None, affirmative=(1,), valid=(1, 2), design=DESIGN).first()
    assert got["estimate"] == 100.0 and got["deff"] is None


def test_batch_equals_single(data, rows):
    domains = [Domain("x", None, "prevalence"), Domain("v", "x == 1", "mean"), Domain("v", None, "quantile", 0.37),
               Domain("v", "x == 1", "quantile", 0.8), Domain("v", "x == 55", "mean")]
    found = {r["domain_key"]: r for r in batch_estimates(data, domains, CATALOG, DESIGN).collect()}
    assert domains[4].key not in found
    keys = ("estimate", "se", "lci", "uci", "n", "n_psu", "n_strata", "denominator_weighted")
    close(found[domains[0].key],
          E.prevalence_ci(data, "x", universe=None, affirmative=(1,), valid=(1, 2), design=DESIGN).first().asDict(),
          (*keys, "deff"))
    close(found[domains[1].key],
          E.mean_ci(data, "v", universe="x == 1", valid=range(0, 30), design=DESIGN).first().asDict(), keys)
    for domain in domains[2:4]:
        close(found[domain.key], Q.quantile_ci(data, "v", domain.q, universe=domain.universe, valid=range(0, 30),
                                               design=DESIGN).first().asDict(), keys)
    mean = found[domains[1].key]
    used = [r for r in rows if r[0] == 1 and not brute.missing(r[1]) and r[1] == int(r[1]) and not brute.missing(r[3])]
    sound = [r for r in rows if r[0] == 1 and valid_v(r)]  # with or without a weight
    assert mean["unweighted"] == pytest.approx(sum(r[1] for r in sound) / len(sound))
    assert mean["reserved_kept"] == pytest.approx(sum(r[1] * r[3] for r in used) / sum(r[3] for r in used))
    assert mean["retained_codes"] == [97]
    kept = [(r[1], r[3]) for r in rows if not brute.missing(r[1]) and r[1] == int(r[1])]
    assert found[domains[2].key]["reserved_kept"] == pytest.approx(brute.quantile(kept, 0.37))


def test_close_quantiles_are_two_domains(data):
    domains = [Domain("v", None, "quantile", q) for q in (0.33333331, 0.33333339)]
    found = batch_estimates(data, domains, CATALOG, DESIGN)
    assert sorted(r["q"] for r in found.collect()) == [0.33333331, 0.33333339]
    asked = data.sparkSession.createDataFrame([(1, "quantile", "v", None, d.q) for d in domains], "id int, k string, x string, u string, z double")
    assert join_estimates(asked, found, kind="k", variable="x", universe="u", q="z").where("estimate is not null").count() == 2


def test_unweighted_variants_count_rows_without_weight(spark):
    data = spark.createDataFrame([(1, float(v), 1, w, 1, v % 3) for v, w in ((2, 1.0), (4, 2.0), (6, None), (8, 3.0))], SCHEMA)
    found = {r["kind"]: r for r in batch_estimates(data, [Domain("v", None, "mean"), Domain("v", None, "quantile", 0.5)], CATALOG, DESIGN).collect()}
    plain = dict(universe=None, valid=range(0, 30), design=DESIGN, weighted=False)
    assert found["mean"]["unweighted"] == E.mean(data, "v", **plain).first()[0] == 5.0
    assert found["quantile"]["unweighted"] == Q.quantile(data, "v", 0.5, **plain).first()[0] == 5.0


def test_a_variable_has_its_own_weight(spark):
    rows = [(1, 1.0, 1, 1.0, 1, 1, 9.0), (2, 2.0, 1, 3.0, 1, 2, 1.0)]
    data = spark.createDataFrame(rows, SCHEMA + ", w2 double")
    catalog = Catalog([Variable("x", "yes or no", None, "all", (1, 2), (1,), "w2")])
    survey = Survey(data, catalog, DESIGN)
    for found in (survey.prevalence("x"), survey.prevalence_ci("x"), batch_estimates(data, [Domain("x", None, "prevalence")], catalog, DESIGN)):
        row = found.first().asDict()
        assert row.get("estimate", row.get("value_pct")) == pytest.approx(90.0)
    assert survey.table("x", "g").first()["estimate"] == pytest.approx(90.0) and survey.table("x", "g").first()["weight"] == "w2"


def test_many_domains_share_one_scan(data, rows, monkeypatch):
    from tallyproof.operators import batch
    tables = []
    monkeypatch.setattr(batch, "written", lambda df, name: tables.append(name) or written(df, name))
    universes = [f"(g {op} {i} | h == {i % 6}) & (p != {i % 4} | v >= {i}) & h <= {9 - i % 7}" for i in range(80) for op in ("==", "<", "!=")]
    domains = [Domain("x", u, "prevalence") for u in universes] + [Domain("v", u, "mean") for u in universes]
    found = {(r["universe"], r["kind"]): r for r in batch_estimates(data, domains, CATALOG, DESIGN).collect()}
    assert tables == ["domain_cells"]

    def holds(text, r):
        names = dict(x=r[0], v=r[1], g=r[2], w=r[3], h=r[4], p=r[5])

        def one(m):
            value, op, number = names[m[1]], m[2], int(m[3])
            if brute.missing(value):
                return str(op == "!=")
            return str(eval(f"{value} {op} {number}"))
        return eval(re.sub(r"([a-z]) (==|!=|<=|>=|<|>) (\d+)", one, text).replace("|", " or ").replace("&", " and "))

    for u in universes:
        inside = [r for r in rows if holds(u, r)]
        shares = [(1.0 if r[0] == 1 else 0.0, r[3], r[4], r[5]) for r in inside if r[0] in (1, 2)]
        values = [(r[1], r[3], r[4], r[5]) for r in inside if valid_v(r)]
        for kind, used, scale in (("prevalence", shares, 100), ("mean", values, 1)):
            if sum(not brute.missing(r[1]) for r in used) == 0:
                assert (u, kind) not in found
                continue
            if sum(r[1] for r in used if not brute.missing(r[1])) == 0:
                continue
            want = brute.ratio_ci(used)
            close(found[u, kind].asDict(), {k: v * (scale if k in ("estimate", "se", "lci", "uci") else 1) for k, v in want.items()})


def test_domains_by_group_equal_tables(data):
    domains = [Domain("v", "x == 1", "mean", None, "g"), Domain("v", None, "quantile", 0.3, "h"), Domain("x", None, "prevalence", None, "g"),
               Domain("x", None, "prevalence"), Domain("v", None, "mean", None, "x")]
    found = grouped_estimates(data, domains, CATALOG, DESIGN).collect()
    keys = ("estimate", "se", "lci", "uci", "n", "denominator_weighted")
    for d in domains[:3] + domains[4:]:
        table = TB.grouped_table(data, d.variable, d.groupby, catalog=CATALOG, design=DESIGN, stat=d.kind, q=d.q or 0.5, universe=d.universe)
        want = {r["group_value"]: r.asDict() for r in table.collect() if r["n"]}
        got = {r["group_value"]: r.asDict() for r in found if r["domain_key"] == d.key}
        assert got.keys() == want.keys() and want
        for g in want:
            close(got[g], want[g], keys)
    alone = [r for r in found if r["groupby"] is None]
    assert len(alone) == 1 and alone[0]["group_value"] is None
    with pytest.raises(ValueError, match="grouped_estimates"):
        batch_estimates(data, domains, CATALOG, DESIGN)


def test_table_cells_equal_single_estimates(data):
    table = TB.grouped_table(data, "v", "g", catalog=CATALOG, design=DESIGN, stat="mean", universe="x == 1").collect()
    assert sorted(r["group_value"] for r in table) == [1, 2, 3]  # 7 is reserved
    for cell in table:
        single = TB.subpopulation_stat(data, "v", universe=f"(g == {cell['group_value']}) & (x == 1)", stat="mean",
                                       catalog=CATALOG, design=DESIGN).first()
        close(cell.asDict(), single.asDict(), ("estimate", "lci", "uci", "se", "n"))


def test_table_errors(data, spark):
    many = spark.createDataFrame([(1, 1.0, i, 1.0, 1, 1) for i in range(100, 130)], SCHEMA)
    args = dict(catalog=CATALOG, design=DESIGN)
    with pytest.raises(ValueError, match="would have 30 rows, 20"):
        TB.grouped_table(many, "x", "g", cap=20, **args)
    assert TB.grouped_table(many, "x", "g", **args).count() == 30
    with pytest.raises(ValueError, match="cannot group by"):
        TB.grouped_table(data, "x", "nothing", **args)
    with pytest.raises(ValueError, match="unknown statistic"):
        TB.grouped_table(data, "x", "g", stat="mode", **args)
    with pytest.raises(ValueError, match="nothing to tabulate"):
        TB.grouped_table(data, "x", "g", universe="x == 55", **args)
    with pytest.raises(KeyError):
        TB.grouped_table(data, "nothing", "g", **args)


def test_empty_subpopulation_is_refused(data):
    for stat in ("prevalence", "mean", "quantile"):
        found = TB.subpopulation_stat(data, "x", universe="x == 55", stat=stat, catalog=CATALOG, design=DESIGN)
        with pytest.raises(Exception, match="empty subpopulation"):
            found.collect()


def test_known_column_keeps_catalog_order(data):
    got = TB.group_values(data, "x", CATALOG).orderBy("place").collect()
    assert [r["group_value"] for r in got] == [1, 2]
    other = TB.group_values(data, "g", CATALOG).orderBy("place").collect()
    assert [r["group_value"] for r in other] == [1, 2, 3]


def test_skewed_psu(spark):
    """One PSU with most of the rows gives the same result as the formula."""
    rows = [(1 if i % 3 else 2, float(i % 30), 1, 1.0 + i % 7, 1, 1 if i % 10 else 2) for i in range(3000)]
    data = spark.createDataFrame(rows, SCHEMA)
    got = E.mean_ci(data, "v", universe=None, valid=range(0, 30), design=DESIGN).first()
    close(got, brute.ratio_ci([(r[1], r[3], r[4], r[5]) for r in rows]))


def test_variance_of_totals_that_are_large_against_their_residuals(spark):
    """50 PSUs in two strata, weights of about 10**12, residuals of about 1: exact fractions tell what is right."""
    from fractions import Fraction

    from tallyproof.operators.estimates import stratified_ratio

    rng = random.Random(12)
    rows = [(i % 2, i, float(rng.randrange(10**12, 2 * 10**12))) for i in range(50)]
    rows = [(h, a, w, 0.5 * w + rng.randrange(-8, 9) / 8) for h, a, w in rows]
    psus = spark.createDataFrame([(h, a, t, w, 1, 0) for h, a, w, t in rows], "h int, a int, s_wy double, s_w double, n long, n_dropped_weight long")
    got = stratified_ratio(psus).first()
    top, bottom = sum(Fraction(r[3]) for r in rows), sum(Fraction(r[2]) for r in rows)
    spread = Fraction(0)
    for h in (0, 1):
        e = [Fraction(t) - top / bottom * Fraction(w) for k, _, w, t in rows if k == h]
        mean = sum(e) / len(e)
        spread += Fraction(len(e), len(e) - 1) * sum((x - mean) ** 2 for x in e)
    assert got["variance"] == pytest.approx(float(spread / bottom**2), rel=1e-3) and got["variance"] > 0


def test_waves_and_sheets_are_read_by_plain_expressions(spark, small):
    """Neither lambdas over arrays nor decimal rounding per row, and cells grouped by plain numbers only: what keeps a pass fast."""
    from tallyproof.operators import batch as B
    from tallyproof.operators import trends as TR
    from tallyproof.plans.claims import DOMAINS
    from tallyproof.plans.micro import CATALOG, DESIGN, WAVES, micro, wave_frames

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    waves = wave_frames(spark, small)
    assert "lambda" not in plan(TR.value_table(waves, WAVES))
    assert "inline" not in plan(TR.trend_prevalence(waves, "sent_back", WAVES))
    assert "round(" not in plan(micro(spark, small))
    seen, keep = [], B.written
    B.written = lambda df, name: seen.append(df) or keep(df, name)
    try:
        B.batch_estimates(micro(spark, small), DOMAINS, CATALOG, DESIGN)
    finally:
        B.written = keep
    assert not [f.name for f in seen[0].schema.fields if f.dataType.typeName() in ("array", "struct", "map")]


def test_whole_numbers_are_those_of_round(spark):
    from tallyproof.plans.micro import _whole

    values = [None, 0.0, -0.0, 0.49999999999999994, 0.5, 1.5, 2.5, -0.5, -1.5, -0.49999999999999994, 28.499999999999996, 28.5, 7.000000000000001, 1e9 + 0.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("v", "cast(round(v) as int) AS expected")
    for row in rows.withColumn("found", _whole(rows.v)).collect():
        assert row["found"] == row["expected"], row


def test_many_comparisons_take_several_words(spark):
    """More comparisons than one whole number has bits: masks of an item fill more than one column."""
    from tallyproof.catalog import Catalog, Design, Variable
    from tallyproof.operators.batch import Domain, batch_estimates

    data = spark.range(400).selectExpr("cast(id % 100 as int) AS age", "cast(id % 2 as int) AS yes", "1D AS w", "cast(id % 3 as int) AS h", "cast(id % 5 as int) AS a")
    catalog = Catalog([Variable("yes", "Yes", None, "All.", (0, 1), (1,), "w")])
    domains = [Domain("yes", f"age < {n}", "prevalence") for n in range(1, 80)] + [Domain("yes", None, "mean")]
    found = {r["universe"]: r for r in batch_estimates(data, domains, catalog, Design("w", "h", "a")).collect()}
    assert len(found) == 80 and found[None]["n"] == 400
    for n in range(1, 80):
        assert found[f"age < {n}"]["n"] == 4 * n
        assert abs(found[f"age < {n}"]["estimate"] - 100 * (n // 2) / n) < 1e-9
