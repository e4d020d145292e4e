"""Every catalogue query against its SQL in an independent engine."""

import duckdb
import pytest

import __spark_entry__
from codeloom.plans import catalogue, driver_graph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalogue.ORACLE:
        assert rows
        return
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: TYPES[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert canonical(got.columns, rows) == canonical(want.columns, want.fetchall())


def test_pairs_of_lines_are_told_apart_after_the_exchange(spark):
    """In the graph that all queries read no task holds the pairs of the lines that it reads."""
    plan = driver_graph.edges(spark, SF).where("relation = 'implements'")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
