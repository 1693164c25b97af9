"""Registered queries against their SQL counterparts on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, canonical

QUICK = ("scan_waves load_variables filter_universe validate_universe prevalence_registry quantile_weighted "
         "ci_prevalence ci_mean ci_quantile table_mean_by group_cap empirical_domain observed_codes tfidf_topk "
         "interp_lookup first_sentence render_concept_docs verify_trend batch_estimate grounded_tables").split()


@pytest.fixture(scope="module")
def base(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, small, base, name):
    df = queries()[name](spark, small)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    relation = base.execute(oracle_sql()[name])
    columns = [c[0] for c in relation.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == canonical(columns, relation.fetchall())


def test_every_query_has_sql():
    from tallyproof.plans.queries import QUERIES

    assert set(QUERIES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    got = entry(spark).first()
    assert (got["estimate"], got["se"], got["n"]) == (68.086224, 2.121998, 898)
    assert got["n_dropped_weight"] > 0 and got["n_dropped_design"] > 0
    assert got["deff"] == 1.860924
