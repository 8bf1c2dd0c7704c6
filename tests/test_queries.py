"""Every registered query of the catalogue against DuckDB on the same tables, rows as sets of texts."""

import os

import duckdb
import pytest

import __spark_entry__
from viaduct.operators import validate
from viaduct.plans import registry, siting

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in registry.ORACLES:
        out = con.execute(registry.ORACLES[name])
        cols = [c[0] for c in out.description]
        want = sorted(tuple(text(r[cols.index(c)]) for c in sorted(cols)) for r in out.fetchall())
        assert sorted(cols) == sorted(df.columns) and rows == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_files_as_made_keep_the_contract(spark):
    validate.require(siting.contract_file1(spark, SF), siting.contract_file2(spark, SF), siting.contract_file3(spark, SF))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
