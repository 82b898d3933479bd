"""Every registered query beside its SQL on the smallest tables."""

import pytest

from gridspark.plans import ORACLES, QUERIES, load
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
load()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(got, db, ORACLES[name]) is None
    else:
        assert got.count() > 0


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns == ["run", "k", "Z", "Bf", "dWPdz", "dEdt", "resid"]
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def _plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a19_vertical_mean_split", "w03_interface_weighted", "w07_moving_geometric_mean", "a23_layer_transport", "a23_layer_transport_refined"])
def test_column_operators_move_no_cells(spark, name):
    assert "Exchange hashpartitioning" not in _plan(spark, name)


@pytest.mark.parametrize("name", ["p05_strided_time", "p06_records_from_end", "a21_mean_of_last", "g12_diffusivity_from_run"])
def test_record_ranges_prune_the_scan(spark, name):
    plan = _plan(spark, name)
    scans = [x for x in plan.split("FileScan parquet")[1:] if "UVEL" in x.split("ReadSchema")[-1][:400] or "KLviscAr" in x.split("ReadSchema")[-1][:400] or "THETA" in x.split("ReadSchema")[-1][:400]]
    assert any("dynamicpruning" in x.split("ReadSchema")[0] for x in scans), plan
