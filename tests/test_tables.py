"""How the derived tables of the plans are built."""

import os
import re

import pytest

from gridspark.plans import tables


@pytest.fixture
def t(spark, tmp_path):
    """Line items of two years over three runs, some with missing keys or values, and one that comes twice."""
    spark.range(60).selectExpr("id AS p_partkey").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id % 97 = 5 THEN NULL ELSE substr('ANR', CAST(id % 3 AS INT) + 1, 1) END AS l_returnflag",
        "CASE WHEN id % 89 = 7 THEN NULL ELSE make_timestamp(2020 + CAST(id % 2 AS INT), 3, 4, 0, 0, 0) END AS l_shipdate",
        "CASE WHEN id % 83 = 9 THEN NULL ELSE CAST(1 + id % 7 AS INT) END AS l_linenumber", "id % 20 AS l_suppkey",
        "CASE WHEN id % 79 = 3 THEN NULL ELSE id % 60 END AS l_partkey", "CAST(id % 10 AS DOUBLE) / 100 AS l_discount", "CAST(id % 8 AS DOUBLE) / 100 AS l_tax",
        "CASE WHEN id % 73 = 1 THEN NULL ELSE CAST(id % 50 AS DOUBLE) END AS l_quantity", "id * 1.5D AS l_extendedprice")
    rows.unionByName(rows.limit(100)).write.parquet(f"{tmp_path}/lineitem.parquet")
    return tables.Tables(spark, str(tmp_path))


def test_no_join_moves_a_cell(t, monkeypatch):
    """Cells are made from water columns where they are written: line items are moved once, in narrow rows."""
    plans = []
    write = tables.write_cells
    monkeypatch.setattr(tables, "write_cells", lambda df, path: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, path))
    assert t.cells.count() == 3 * 2 * 7 * 8 * 2
    assert len(plans) == 1 and "hashpartitioning" not in plans[0]


def test_a_bucket_is_one_file(t):
    """A task that writes water columns sorts one bucket, whatever the size of the cells' files."""
    files = t.columns.inputFiles()
    assert len(files) == len({re.search(r"_(\d{5})\.", os.path.basename(f)).group(1) for f in files}) > 1


def test_cells_have_the_sums_of_their_line_items(t):
    """Positions without line items are 0, rows without a key belong to none; the columns hold the same cells."""
    lines = t.given("lineitem").selectExpr(
        "l_returnflag AS run", "year(l_shipdate) - 2020 AS rec", "l_linenumber - 1 AS k", "CAST(l_suppkey % 8 AS INT) AS j", "CAST(floor(l_partkey / 50) AS INT) AS i", "l_quantity AS q")
    sums = {tuple(r)[:5]: r.q or 0 for r in lines.dropna(subset=["run", "rec", "k", "j", "i"]).groupBy("run", "rec", "k", "j", "i").agg({"q": "sum"}).withColumnRenamed("sum(q)", "q").collect()}
    cells = {tuple(r)[:5]: r.KLviscAr for r in t.cells.select("run", "rec", "k", "j", "i", "KLviscAr").collect()}
    assert all(v == (1 + int(sums.get(key, 0)) % 50) / 1024 for key, v in cells.items()) and set(sums) <= set(cells)
    cells, columns = t.cells.drop("stream"), t.columns.select(*[c for c in t.cells.columns if c != "stream"])
    assert cells.exceptAll(columns).count() == 0 and columns.exceptAll(cells).count() == 0
