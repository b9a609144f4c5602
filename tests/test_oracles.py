"""Every query with an oracle: Spark result equals DuckDB's on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.plans import ORACLES, QUERIES
from tools.oracle_check import TABLES, norm

from conftest import SF_SMALL



@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    got = _rows(df.columns, df.collect())
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = _rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_every_query_runs(spark):
    for name, fn in entry.queries().items():
        if name in ORACLES or name not in QUERIES:
            continue
        fn(spark, SF_SMALL).write.format("noop").mode("overwrite").save()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 9
