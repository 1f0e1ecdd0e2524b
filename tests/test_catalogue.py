import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted([tuple(round(float(x), 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_like_sql(spark, db, name):
    want = db.sql(catalogue.SQL[name])
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    assert dict(got.dtypes) == {c: kinds[str(t)] for c, t in zip(want.columns, want.types)}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 826
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
