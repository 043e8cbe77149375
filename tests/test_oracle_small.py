"""Every registered query against its DuckDB oracle on the smallest scale."""

import os

import pytest

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _con():
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        return repr(round(v, 6)) if isinstance(v, float) else repr(v)

    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


def _names():
    from txgraph.plans.catalog import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.fixture(scope="module")
def con():
    return _con()


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_entry_report(spark):
    from __spark_entry__ import entry

    row = entry(spark).first()
    assert row.edges == 6000 and row.components == 338
    assert row.greatest_vertices == 117
