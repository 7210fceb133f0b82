import duckdb
import pytest

from glintscan.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("pages", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if not n[:4].rstrip("_").removeprefix("d_").isdigit()])
def test_query_and_sql_agree(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    if name in registry.ORACLES:
        want = con.sql(registry.ORACLES[name])
        assert sorted(want.columns) == columns
        assert rows == sorted(str(tuple(dict(zip(want.columns, r))[c] for c in columns)) for r in want.fetchall())
    assert rows or name.startswith(("e_", "scan_documents"))


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).head(1)) == 1
    assert set(e.oracle_sql()) <= set(e.queries())
