import json

import pytest

from tallyproof import WaveCatalog, WaveVariable
from tallyproof.operators import requests as R
from tallyproof.operators import rows as RW
from tallyproof.operators import tables as TB
from tallyproof.operators import trends as TR
from tallyproof.operators import verify as V
from tallyproof.sources import microdata as M
from tallyproof.sources.claims import TREND_SCHEMA, load_claims, load_trend_claims, malformed_records

from . import brute
from .test_estimates import CATALOG, DESIGN, SCHEMA, make_rows, valid_v


@pytest.fixture(scope="module")
def rows():
    return make_rows(600, 9)


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def claim(cid, variable, value=None, **more):
    claim_keys = ("kind", "quantile_q", "unit", "tolerance", "ci_95", "statistic")
    record = {"id": cid, "variable": variable, "label": cid, "prose": "Some text.", "links": []}
    record |= {k: v for k, v in more.items() if k not in (*claim_keys, "universe", "weighted", "old_key")}
    if value is not None:
        record["claim"] = {k: more[k] for k in claim_keys if k in more}
        record["claim"]["value_pct" if more.get("old_key") else "value"] = value
        record["claim"]["method"] = {"universe_expr": more.get("universe"), "weighted": more.get("weighted", True)}
    return record


def load(spark, tmp_path, records, loader=load_claims):
    path = tmp_path / "claims.json"
    path.write_text("\n".join(json.dumps(r) for r in records))
    return loader(spark, str(path))


def judged(spark, tmp_path, data, records):
    found = V.verify_claims(data, load(spark, tmp_path, records), CATALOG, DESIGN).collect()
    return {r["id"]: r for r in found}


def test_defaults_and_old_keys(spark, tmp_path):
    got = {r["id"]: r for r in load(spark, tmp_path, [
        claim("a", "x", 5.0, old_key=True), claim("b", "v", 6.0, kind="mean", tolerance=0.1), {"id": "c", "variable": "x"},
    ]).collect()}
    assert (got["a"]["claimed"], got["a"]["tolerance"], got["a"]["kind"], got["a"]["unit"]) == (5.0, 0.5, "prevalence", "%")
    assert (got["b"]["claimed"], got["b"]["tolerance"], got["b"]["unit"]) == (6.0, 0.1, "")
    assert got["c"]["claimed"] is None and got["c"]["links"] == [] and not got["c"]["seeded_defect"]


def test_verdicts(spark, tmp_path, data, rows):
    share = 100 * brute.ratio_ci([(1.0 if r[0] == 1 else 0.0, r[3], r[4], r[5]) for r in rows if r[0] in (1, 2)])["estimate"]
    used = [r for r in rows if r[0] == 1 and valid_v(r)]
    mean = brute.ratio_ci([(r[1], r[3], r[4], r[5]) for r in used])["estimate"]
    kept = [r for r in rows if r[0] == 1 and not brute.missing(r[1]) and r[1] == int(r[1]) and not brute.missing(r[3])]
    with_reserved = sum(r[1] * r[3] for r in kept) / sum(r[3] for r in kept)
    plain = [r[1] for r in used]
    plain = sum(plain) / len(plain)
    median = brute.quantile([(r[1], r[3]) for r in rows if valid_v(r)], 0.5)
    assert abs(with_reserved - mean) > 0.35 and abs(plain - mean) > 0.02
    got = judged(spark, tmp_path, data, [
        claim("right", "x", share),
        claim("wrong", "x", share + 5),                                   # right method, wrong figure
        claim("method", "x", share + 5, universe="g == 1", weighted=False),
        claim("tight", "x", share, ci_95=[share - 0.2, share + 0.2]),
        claim("mean", "v", mean, kind="mean", universe="x == 1"),
        claim("reserved", "v", with_reserved, kind="mean", universe="x == 1", tolerance=0.3),
        claim("plain", "v", plain, kind="mean", universe="x == 1", tolerance=0.01),
        claim("far", "v", 500.0, kind="mean", universe="x == 1"),
        claim("median", "v", median, kind="quantile", analytical_universe="g > 0 | g < 1 | g != 1"),
        claim("described", "x", links=["right", "v"]),
        claim("bare", "x", prose="  "),
        claim("dead", "x", share, links=["nowhere", "right"]),
        claim("odd", "nothing", 3.0),
        claim("empty", "x", 3.0, analytical_universe="g == 55"),
        claim("bad", "x", 3.0, analytical_universe="g.__class__"),
    ])
    assert {k: r["verdict"] for k, r in got.items()} == {
        "right": "PASS", "wrong": "FAIL", "method": "FAIL", "tight": "FAIL", "mean": "PASS", "reserved": "FAIL",
        "plain": "FAIL", "far": "FAIL", "median": "PASS", "described": "DESCRIPTIVE", "bare": "FAIL", "dead": "PASS",
        "odd": "FAIL", "empty": "FAIL", "bad": "FAIL"}
    text = {k: " ".join(r["diagnosis"]) for k, r in got.items()}
    assert "differs from the right value" in text["wrong"]
    assert "without the weight w" in text["method"] and "about g == 1" in text["method"]
    assert "to either side" in text["tight"] and "keeps reserved codes (97)" in text["reserved"]
    assert "equals the unweighted estimate" in text["plain"] and "differs" in text["far"]
    assert got["dead"]["lint_messages"] == ["link to nothing: nowhere"] and not got["dead"]["lint_ok"]
    assert got["bare"]["lint_messages"] == ["there is no text"] and not got["bare"]["caught"]
    assert "not in the catalog: nothing" in got["odd"]["lint_messages"]
    assert got["wrong"]["caught"] and got["wrong"]["delta"] == pytest.approx(5.0)
    assert got["right"]["right_value"] == pytest.approx(share, abs=0.005)


def test_totals_and_invariant(spark):
    verdicts = spark.createDataFrame(
        [("PASS", False, False), ("FAIL", True, True), ("DESCRIPTIVE", False, False)], "verdict string, caught boolean, seeded_defect boolean")
    assert V.caught_count(verdicts).first().asDict() == dict(claims=3, passed=1, failed=1, descriptive=1, caught=1, real_failures=0)
    assert V.compile_invariant(verdicts).first()["ok"]
    assert not V.compile_invariant(verdicts.withColumn("seeded_defect", verdicts.verdict == "PASS")).first()["ok"]


WAVES = WaveCatalog([
    WaveVariable("yes", 1, "old_x", "old_w", (1, 2, 3), (1,), "categorical"),
    WaveVariable("yes", 2, "x", "w", (1, 2), (1,), "categorical"),
    WaveVariable("size", 1, "old_size", "old_w", range(1000, 9999), (), "continuous"),
    WaveVariable("size", 2, "size", "w", (1, 2, 3, 4), (), "categorical"),
])


@pytest.fixture(scope="module")
def waves(spark):
    old = spark.createDataFrame([(1, 1500, 1.0), (2, 2500, 1.0), (3, 9999, 2.0), (7, 1800, 9.0)], "old_x int, old_size int, old_w double")
    new = spark.createDataFrame([(1, 1, 1.0), (2, 4, 3.0), (9, 2, 5.0)], "x int, size int, w double")
    return {1: old, 2: new}


def trend(cid, canonical, values, single=None, per_year=None, prose="Text.", years=(1, 2)):
    method = {"single_variable": single, "per_year_variable": per_year}
    return {"id": cid, "canonical": canonical, "years": list(years), "prose": prose,
            "claim": {"statistic": "s", "method": method, "values_pct": values}}


def test_trends(spark, tmp_path, waves):
    shares = {r["wave"]: r["value_pct"] for r in TR.trend_prevalence(waves, "yes", WAVES).collect()}
    assert shares == pytest.approx({1: 25.0, 2: 25.0})
    stated = load(spark, tmp_path, [
        trend("right", "yes", {"1": 25.2, "2": 25.0}, per_year={"1": "old_x", "2": "x"}),
        trend("renamed", "yes", {"1": 25.0, "2": 25.0}, single="x"),
        trend("off", "yes", {"1": 30.0}, per_year={"1": "old_x", "2": "x"}),
        trend("recoded", "size", {"1": 1.0, "2": 2.0}, per_year={"1": "old_size", "2": "size"}),
        trend("unknown", "nothing", {"1": 1.0, "2": 2.0}, single="x"),
    ], load_trend_claims)
    got = {r["id"]: r for r in TR.verify_trends(stated, waves, WAVES).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == dict(
        right="PASS", renamed="FAIL", off="FAIL", recoded="FAIL", unknown="FAIL")
    assert got["right"]["right_values"] == {1: 25.0, 2: 25.0}
    assert got["renamed"]["diagnosis"] == ["1: column x is not in this wave, it was renamed; the right column is old_x"]
    assert len(got["off"]["diagnosis"]) == 2 and "2: no value is claimed" in got["off"]["diagnosis"]
    assert "different scales" in got["recoded"]["diagnosis"][0] and got["recoded"]["right_values"] == {}
    assert not got["unknown"]["lint_ok"] and not got["unknown"]["caught"] and got["renamed"]["caught"]
    assert TR.waves_missing(stated, waves).isEmpty()
    assert [r["year"] for r in TR.waves_missing(stated, {2: waves[2]}).collect()] == [1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_waves_in_one_table(spark, tmp_path, waves):
    table = M.partition_waves(waves, f"{tmp_path}/waves")
    again = M.open_waves(spark, f"{tmp_path}/waves")
    assert list(again) == [1, 2] and again.columns == {1: {"old_x", "old_size", "old_w"}, 2: {"x", "size", "w"}} == table.columns
    for measure in ("yes", "size"):
        found = TR.trend_prevalence(again, measure, WAVES)
        assert sorted(found.collect()) == sorted(TR.trend_prevalence(waves, measure, WAVES).collect())
        plan = plan_of(found)
        assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(wave" in plan or "PartitionFilters: [wave" in plan
    assert sorted(TR.empirical_domain(again, WAVES).collect()) == sorted(TR.empirical_domain(waves, WAVES).collect())
    only = WaveCatalog([e for e in WAVES if e.wave == 2])
    assert [r["wave"] for r in TR.trend_prevalence(again, "yes", only).collect()] == [2]
    stated = load(spark, tmp_path, [
        trend("right", "yes", {"1": 25.2, "2": 25.0}, per_year={"1": "old_x", "2": "x"}),
        trend("renamed", "yes", {"1": 25.0, "2": 25.0}, single="x"),
        trend("later", "yes", {"1": 25.0, "3": 25.0}, per_year={"1": "old_x", "3": "x"}, years=(1, 3))], load_trend_claims)
    key = lambda r: r["id"]
    assert sorted(TR.verify_trends(stated, again, WAVES).collect(), key=key) == sorted(TR.verify_trends(stated, waves, WAVES).collect(), key=key)
    assert [r["year"] for r in TR.waves_missing(stated, again).collect()] == [3]
    lacking = WaveCatalog([WaveVariable("yes", 2, "old_x", "w", (1, 2), (1,), "categorical")])
    with pytest.raises(ValueError, match="wave 2 has no column old_x"):
        TR.trend_prevalence(again, "yes", lacking)
    with pytest.raises(ValueError, match="named wave: 7"):
        M.partition_waves({7: waves[1].withColumnRenamed("old_x", "wave")}, f"{tmp_path}/other")


def test_domain_falls_back_to_the_declared_encoding(spark, waves):
    empty = {1: waves[1].where("old_size = 0"), 2: waves[2]}
    got = {(r["canonical"], r["wave"]): r for r in TR.empirical_domain(empty, WAVES).collect()}
    assert (got["size", 1]["encoding"], got["size", 1]["cardinality"], got["size", 1]["lo"]) == ("continuous", 0, None)


def test_requests(spark, data):
    asked = spark.createDataFrame([
        ("a", "x", "g == 1", "prevalence", None), ("b", "v", "", "quantile", None), ("c", "h", None, "mean", None),
        ("d", "x", "g == 55", "prevalence", None), ("e", "x", "import os", "prevalence", None), ("f", "x", None, "mode", None),
        ("g", "v", None, "quantile", 1.5)], R.REQUEST_SCHEMA)
    backed = spark.createDataFrame([("x",), ("v",)], "variable string")
    got = {r["request_id"]: r for r in R.grounded_or_refuse(data, asked, backed, CATALOG, DESIGN).collect()}
    assert {k for k, r in got.items() if r["status"] == "answered"} == {"a", "b"}
    assert "not backed" in got["c"]["reason"] and got["d"]["reason"] == "empty subpopulation"
    assert "universe" in got["e"]["reason"] and "unknown statistic" in got["f"]["reason"] and "between" in got["g"]["reason"]


def test_requests_for_tables(spark, data):
    asked = spark.createDataFrame([
        ("a", "v", "x == 1", "mean", None, "g"), ("b", "x", None, "prevalence", None, "h"), ("c", "v", None, "quantile", None, ""),
        ("d", "x", None, "prevalence", None, "nothing"), ("e", "x", "g == 55", "prevalence", None, "g"), ("f", "h", None, "mean", None, "g"),
        ("g", "v", None, "mean", None, "p")], R.TABLE_REQUEST_SCHEMA)
    backed = spark.createDataFrame([("x",), ("v",)], "variable string")
    got = R.grounded_tables(data, asked, backed, CATALOG, DESIGN).collect()
    for key, variable, groupby, options in (("a", "v", "g", dict(stat="mean", universe="x == 1")), ("b", "x", "h", {}), ("g", "v", "p", dict(stat="mean"))):
        table = TB.grouped_table(data, variable, groupby, catalog=CATALOG, design=DESIGN, **options).collect()
        mine = {r["group_value"]: r for r in got if r["request_id"] == key}
        assert len(mine) == len(table) > 1
        for r in table:
            assert mine[r["group_value"]]["status"] == "answered" and mine[r["group_value"]]["n"] == r["n"]
            assert mine[r["group_value"]]["estimate"] == pytest.approx(r["estimate"])
    rest = {r["request_id"]: r for r in got if r["request_id"] in "cdef"}
    assert rest["c"]["status"] == "answered" and rest["c"]["group_value"] is None
    assert "group by" in rest["d"]["reason"] and "nothing to tabulate" in rest["e"]["reason"] and "not backed" in rest["f"]["reason"]


def test_rows(data):
    got = RW.inspect_rows(data, ["g", "x"], universe="x == 1", limit=5)
    assert got.columns == ["g", "x"] and got.count() == 5
    assert RW.inspect_rows(data, ["x"], limit=10_000).count() == data.count()
    for columns, limit, message in ([[], 5, "which columns"], [["x"], 0, "shows no rows"], [["x", "nothing"], 5, "no such columns: nothing"]):
        with pytest.raises(ValueError, match=message):
            RW.inspect_rows(data, columns, limit=limit)
    with pytest.raises(ValueError, match="universe"):
        RW.inspect_rows(data, ["x"], universe="x.__class__", limit=1)


def test_codes_are_rows(data, rows):
    got = {(r["variable"], r["code"]): (r["rows"], r["valid"]) for r in RW.code_counts(data, ["x", "v", "x"], CATALOG).collect()}
    want = {}
    for r in rows:
        for name, value, valid in (("x", r[0], r[0] in (1, 2)), ("v", r[1], valid_v(r))):
            if not brute.missing(value) and value == int(value):
                want[name, int(value)] = (want.get((name, int(value)), (0, valid))[0] + 1, valid)
    assert got == want and got["v", 97][1] is False
    assert RW.code_counts(data.where("false"), ["x"], CATALOG).isEmpty()
    with pytest.raises(ValueError, match="nothing"):
        RW.code_counts(data, ["nothing"], CATALOG)


def test_rows_with_meanings(spark, data):
    backed = spark.createDataFrame([("v",)], "variable string")
    got = RW.rows_with_meanings(data, ["v", "x", "nothing"], CATALOG, backed, limit=4, universe="x == 2", order_by=["v"]).collect()
    texts = {(r["part"], r["place"]): r["text"] for r in got}
    assert len(got) == 8 and texts["warning", 0] == RW.WARNING
    assert "codes 0..29" in texts["column", 0] and "nothing published" in texts["column", 1] and "nothing published" in texts["column", 2]
    assert all("x=2" in texts["row", k] for k in range(1, 5))


def test_grounded_table(spark, data):
    backed = spark.createDataFrame([("v",)], "variable string")
    table = R.grounded_table(data, backed, "v", "g", catalog=CATALOG, design=DESIGN, stat="mean")
    assert sorted(r["group_value"] for r in table.collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="not backed"):
        R.grounded_table(data, backed, "x", "g", catalog=CATALOG, design=DESIGN)


def test_a_wave_without_a_column_is_an_error(spark, data):
    waves = WaveCatalog([WaveVariable("m", 1, "x", "w", (1, 2), (1,), "categorical"), WaveVariable("m", 2, "x", "w2", (1, 2), (1,), "categorical")])
    with pytest.raises(ValueError, match="wave 2 has no column w2"):
        TR.trend_prevalence({1: data, 2: data}, "m", waves)
    assert {r["wave"] for r in TR.trend_prevalence({1: data}, "m", waves).collect()} == {1}


def test_malformed_lines_are_reported_and_never_half_read(spark, tmp_path):
    lines = [json.dumps(claim("a", "x", 5.0)), '{"id": "b", "variable": "x", "claim": {"value": "much"}}', '{"id": "c", "vari', "[1]", '"text"', "null", "", "  ",
             '{"id": "d", "variable": "x", "links": "one"}', json.dumps({"id": "e", "variable": "x"})]
    path = tmp_path / "claims.json"
    path.write_text("\n".join(lines))
    assert {r["id"] for r in load_claims(spark, str(path)).collect()} == {"a", "e"}
    bad = malformed_records(spark, str(path)).collect()
    assert sorted(r["line"] for r in bad) == sorted(lines[1:6] + [lines[8]]) and all(r["file"].endswith("claims.json") for r in bad)
    (tmp_path / "trends.json").write_text('{"id": "t", "years": [1]}\n{"id": "u", "years": 5}')
    assert [r["id"] for r in load_trend_claims(spark, str(tmp_path / "trends.json")).collect()] == ["t"]
    assert malformed_records(spark, str(tmp_path / "trends.json"), TREND_SCHEMA).count() == 1
