"""Queries against SQL in DuckDB on the smallest tables, whole or by the columns that SQL can express."""

import os

import duckdb
import pytest

from loomstone.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
URL = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
#: What SQL can express of queries without SQL of their own.
PARTS = {
    "op2_token_files": "SELECT doc_id FROM documents",
    "op3_boosted_quality": "SELECT doc_id FROM documents",
    "op7_source_mixing": """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents)
        SELECT doc_id, n AS size, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM d""",
    "op9_weighted_sampling": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
        o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM d)
        SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 4) || substr(after, 1, n // 4)) AS edited_sha256 FROM o""",
    "op10_host_trust": f"""WITH u AS (SELECT page_id, coalesce({URL}, '') AS u FROM pages),
        p AS (SELECT page_id, lower(regexp_extract(u, '^[^/?#]*')) AS host, regexp_extract(regexp_replace(u, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
        r(rule_host, start) AS (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/')),
        f AS (SELECT page_id, arg_max(rule_host || start, length(rule_host || start)) AS rule FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, start) GROUP BY 1)
        SELECT p.page_id, host, path, rule FROM p LEFT JOIN f ON f.page_id = p.page_id""",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted({**PARTS, **registry.ORACLE_SQL}))
def test_query_matches_sql(spark, duck, name):
    out = duck.execute(registry.ORACLE_SQL.get(name, PARTS.get(name)))
    names = [d[0] for d in out.description]
    want = sorted(map(repr, out.fetchall()))
    got = registry.QUERIES[name](spark, DATA)
    assert name in PARTS or sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == want
