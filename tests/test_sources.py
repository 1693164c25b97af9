import time

import pytest
from pyspark.sql import functions as F

from tallyproof.catalog import Catalog, compact_codes, unknown_variables
from tallyproof.operators import estimates as E
from tallyproof.plans.micro import CATALOG, DESIGN, micro
from tallyproof.session import scratch_dir
from tallyproof.sources import bundle as B
from tallyproof.sources import microdata as M


@pytest.fixture(scope="module")
def csv(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("csv") / "micro")
    data = micro(spark, small)
    data.write.option("header", True).csv(path)
    return path, data.schema


def test_csv_equals_parquet(spark, csv, tmp_path):
    path, schema = csv
    copy = M.materialize_parquet(spark, path, f"{tmp_path}/copy", schema=schema)
    one, two = M.scan_csv(spark, path, schema=schema), M.scan_parquet(spark, copy)
    settings = dict(universe="outcome == 3", affirmative=(1, 2), valid=(0, 1, 2), design=DESIGN)
    first = E.prevalence_ci(one, "refund", **settings).first().asDict()
    second = E.prevalence_ci(two, "refund", **settings).first().asDict()
    assert first == pytest.approx(second)
    inferred = M.scan_csv(spark, path)
    assert E.prevalence_ci(inferred, "refund", **settings).first().asDict() == pytest.approx(second)


def test_projection_is_requested_and_present(spark, csv):
    path, schema = csv
    assert M.scan_csv(spark, path, ["wt", "nothing", "yr"], schema).columns == ["wt", "yr"]


def test_copy_is_rebuilt_only_when_stale(spark, tmp_path):
    source, copy = f"{tmp_path}/s", f"{tmp_path}/c"
    spark.range(3).write.option("header", True).csv(source)
    M.materialize_parquet(spark, source, copy)
    first = M.last_modified(spark, copy)
    M.materialize_parquet(spark, source, copy)
    assert M.last_modified(spark, copy) == first
    time.sleep(0.05)
    M.materialize_parquet(spark, source, copy, force=True)
    second = M.last_modified(spark, copy)
    assert second > first
    time.sleep(0.05)
    spark.range(5).write.mode("overwrite").option("header", True).csv(source)
    M.materialize_parquet(spark, source, copy)
    assert spark.read.parquet(copy).count() == 5


def test_load_prefers_the_copy(spark, tmp_path):
    source, copy = f"{tmp_path}/s", f"{tmp_path}/c"
    with pytest.raises(FileNotFoundError):
        M.load_microdata(spark, source, copy)
    spark.range(3).write.option("header", True).csv(source)
    assert M.load_microdata(spark, source, copy).count() == 3
    spark.range(4).write.parquet(copy)
    assert M.load_microdata(spark, source, copy, ["id", "nothing"]).count() == 4


def test_waves_keep_missing_columns(spark):
    waves = M.scan_waves({2: spark.range(2).withColumn("a", F.lit(1)), 1: spark.range(1).withColumn("b", F.lit(2))})
    assert waves.columns == ["wave", "id", "b", "a"]
    assert waves.where("a IS NULL").count() == 1


def test_catalog_round_trip(spark):
    again = Catalog.from_frame(CATALOG.as_frame(spark))
    assert {v.name: v for v in again} == {v.name: v for v in CATALOG}
    with pytest.raises(KeyError, match="known"):
        CATALOG["nothing"]
    asked = spark.createDataFrame([("outcome",), ("nothing",)], "variable string")
    assert [r[0] for r in unknown_variables(asked, CATALOG.as_frame(spark)).collect()] == ["nothing"]
    assert compact_codes([3, 4, 5]) == range(3, 6) and compact_codes([1, 2]) == (1, 2) and compact_codes([1, 3, 4]) == (1, 3, 4)


def test_scratch_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark).startswith(root) and scratch_dir(spark) != scratch_dir(spark)


def test_scan_reads_only_needed_columns(spark, small):
    data = micro(spark, small)
    plan = E.mean(data, "cut", universe="quarter == 2", valid=range(0, 11), design=DESIGN)
    text = plan._jdf.queryExecution().executedPlan().toString()
    schema = text[text.index("ReadSchema"):]
    assert "l_returnflag" not in schema and "l_tax" not in schema


def test_csv_columns_are_found_by_name(spark, tmp_path):
    """The file has its columns in another order than the schema."""
    from pyspark.sql import types as T

    (tmp_path / "t.csv").write_text("b,c,a\n1,x,2\n3,y,4\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    path = str(tmp_path / "t.csv")
    assert [tuple(r) for r in M.scan_csv(spark, path, ["a"], schema).collect()] == [(2,), (4,)]
    assert [tuple(r) for r in M.scan_csv(spark, path, None, schema).collect()] == [(2, 1.0), (4, 3.0)]
    copy = M.materialize_parquet(spark, path, str(tmp_path / "copy"), schema=schema)
    assert sorted(r["a"] for r in spark.read.parquet(copy).collect()) == [2, 4]
    (tmp_path / "bad.csv").write_text("a,b\n1,word\n")
    with pytest.raises(Exception, match="MALFORMED|word"):
        M.scan_csv(spark, str(tmp_path / "bad.csv"), None, schema).collect()


def _version(spark, number):
    docs = spark.createDataFrame([(f"d{number}",)], "id string")
    verdicts = spark.createDataFrame([("a", "FAIL"), ("b", "PASS")], "id string, verdict string")
    return docs, verdicts, spark.createDataFrame([(f"run {number}",)], "note string")


def test_a_bundle_is_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "bundle")
    assert B.snapshot(spark, path) is None
    with pytest.raises(FileNotFoundError):
        B.scan_bundle(spark, path)
    first = B.publish_bundle(*_version(spark, 1), path)
    assert [r["id"] for r in first.table("quarantine").collect()] == ["a"]
    docs, verdicts, log = _version(spark, 2)
    broken = log.select(F.raise_error(F.lit("lost")).alias("note"))
    with pytest.raises(Exception, match="lost"):  # between the tables of a version
        B.publish_bundle(docs, verdicts, broken, path)
    assert B.snapshot(spark, path) == first and [r["id"] for r in B.scan_bundle(spark, path).collect()] == ["d1"]
    second = B.publish_bundle(docs, verdicts, log, path)
    assert (first.number, second.number) == (1, 2) and [r["id"] for r in B.scan_bundle(spark, path).collect()] == ["d2"]
    assert [r["id"] for r in first.table("published").collect()] == ["d1"]  # a reader of the version before goes on
    assert sorted((r["number"], r["note"]) for r in B.scan_audit(spark, path).collect()) == [(1, "run 1"), (2, "run 2")]
