"""Every registered query beside its SQL, on the smallest tables."""

import duckdb
import pytest

from ostrakon.queries import ORACLE, QUERIES

#: Queries that find nothing on the smallest tables.
EMPTY = {"e7_converges", "v6_interactions"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def key(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float)) else "n"), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=key)
    assert len(got) == len(want) and (got or name in EMPTY)
    for g, w in zip(got, want):
        assert g == w


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.columns) > 0 and (df.count() > 0 or name in EMPTY)
