"""Each query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from loomstone.plans import everything

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(everything.SQL))
def test_query_matches_sql(spark, duck, name):
    df = everything.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    out = duck.execute(everything.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert found == Counter(repr([plain(r[i]) for i in at]) for r in out.fetchall())
