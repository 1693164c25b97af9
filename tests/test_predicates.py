import pytest
from pyspark.sql import functions as F

from tallyproof.functions import predicates as P

COLUMNS = {"ever_a", "med_a", "pre_a", "sex_a", "wt_a", "age_a"}


@pytest.mark.parametrize("expr", [
    None, "age_a<=30", " wt_a > 0.25 ", "((pre_a == -2))", "age_a > 17 & age_a <= 64 | sex_a != 1", "(med_a < 2 | (pre_a >= 1 & age_a != 40))",
])
def test_accepted(expr):
    P.validate_universe(expr, COLUMNS)


@pytest.mark.parametrize("expr", [
    "", "  ", "()", "age_a", "30 < age_a", "age_a < pre_a", "age_a < '30'", "age_a < 30.", "age_a = 30", "shoe_a < 30", "age_a < 30 pre_a < 2",
    "age_a < 30 &", "age_a < 30 & & pre_a < 2", "(age_a < 30", "age_a < 30)", "not age_a < 30", "age_a < 30 or pre_a < 2", "abs(age_a) < 30",
    "age_a.real < 30", "age_a < 30; drop table t", 12.5,
])
def test_rejected(expr):
    with pytest.raises(ValueError, match="universe"):
        P.validate_universe(expr, COLUMNS)


@pytest.fixture(scope="module")
def codes(spark):
    nan = float("nan")
    return spark.createDataFrame(
        [(1, 1, 2.0, 5.0), (2, 2, None, nan), (3, None, 1.0, None), (4, 9, 2.5, 100.0)], "id int, a int, b double, c double"
    )


@pytest.mark.parametrize("expr, ids", [
    (None, [1, 2, 3, 4]),
    ("a == 1", [1]),
    ("a != 1", [2, 3, 4]),            # missing differs from every code
    ("b != 2", [2, 3, 4]),
    ("c != 5", [2, 3, 4]),
    ("c > 5", [4]),                   # NaN is not above anything
    ("c >= 0", [1, 4]),
    ("c < 200", [1, 4]),
    ("a <= 2", [1, 2]),
    ("a == 9 | a == 1 & b == 9", [4]),  # AND first
    ("(a == 9 | a == 1) & b == 2", [1]),
    ("b == 2.5", [4]),
    ("a == 1 & b == 2", [1]),
])
def test_meaning(codes, expr, ids):
    got = sorted(r["id"] for r in codes.where(P.universe_filter(codes, expr)).collect())
    assert got == ids


def test_predicate_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("int").alias("a")).write.parquet(f"{tmp_path}/t")
    data = spark.read.parquet(f"{tmp_path}/t")
    plan = data.where(P.universe_filter(data, "(a == 1) | (a > 5)"))._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualTo(a,1),GreaterThan(a,5))" in plan


def test_text_column_is_refused(spark):
    data = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError, match="numbers only"):
        P.universe_filter(data, "a == 1")


def test_ranges_hold_whole_numbers_only(spark):
    data = spark.createDataFrame([(1.0,), (1.5,), (3.0,), (float("nan"),), (None,)], "v double")
    inside = data.where(P.in_codes(data, "v", range(0, 3))).collect()
    assert [r["v"] for r in inside] == [1.0]
    assert data.where(P.in_codes(data, "v", ())).count() == 0
    assert data.where(P.integer_like(data, "v")).count() == 2



def test_alternatives(codes):
    assert P.universe_terms(codes, None) == {frozenset()}
    assert P.universe_terms(codes, "(a == 1 | b < 2) & id > 1 | a == 9") == {
        frozenset({"`a` = 1", "`id` > 1"}), frozenset({"`b` < 2", "`id` > 1"}), frozenset({"`a` = 9"})}
    many = " & ".join(f"(a == {i} | id == {i})" for i in range(8))  # 2 ** 8 alternatives
    whole, = P.universe_terms(codes, many)
    assert whole == {f"({P.universe_sql(codes, many)})"}
