"""Every core query against its SQL on DuckDB, and against itself on other numbers of partitions."""

import math
import os

import duckdb
import pytest

from waymark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(v)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert {f.name: KINDS[f.dataType.simpleString()] for f in got.schema} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


@pytest.mark.parametrize("name", ["knn_ip_topk", "fifo_replay", "stable_order", "directory_children"])
def test_partitions_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "4", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[name](spark, SF)
            found.append(rows(df.columns, [tuple(r) for r in df.collect()]))
        assert found[0] == found[1] == found[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
