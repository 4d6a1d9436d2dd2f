"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows, columns):
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(clean(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    if name not in queries.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    columns = sorted(names)
    assert canon(rows, columns) == canon(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(queries.QUERIES) <= set(entry.queries())
