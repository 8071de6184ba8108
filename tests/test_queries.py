"""A sample of registered queries against their SQL twins at the smallest scale; ``check.py`` runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, canonical

SF = "/root/testdata/sf0.001"
SAMPLE = ["success_rate_cells", "stratified_sample", "rand_indices", "assign_models", "nearest_label", "kmeans_steps", "witness_edges_relaxed", "choose_level", "mdl_bits"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sql, name):
    got = canonical(entry_points.queries()[name](spark, SF).toPandas())
    want = canonical(sql.execute(entry_points.oracle_sql()[name]).df())
    assert got[1] == want[1] and repr(got[0]) == repr(want[0])


def test_contract(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).columns == ["mi", "nmi"]


def test_scratch_is_dropped(spark):
    from cumulus.session import drop_scratch, materialise

    kept = materialise(spark.range(3))
    assert kept.count() == 3 and drop_scratch(spark) >= 1
