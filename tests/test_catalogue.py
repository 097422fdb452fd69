"""Every registered query of the main library against its SQL on the smallest tables."""

import duckdb
import pytest

from hayloft.plans import catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = oracle.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.SQL) == set(catalogue.QUERIES)


def test_plans_keep_their_shape(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan(catalogue.QUERIES["knn_per_class_topk"](spark, SF))
    assert "WindowGroupLimit" in plan(catalogue.QUERIES["knn_exact_topk"](spark, SF))  # every stated query has its own best rows
    assert "CartesianProduct" not in plan(catalogue.QUERIES["bm25_topk"](spark, SF))
