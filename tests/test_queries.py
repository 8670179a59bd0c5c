from __future__ import annotations

import os

import pytest
from lexigrove import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_suffix_array_of_parts_has_every_row(spark, tmp_path):
    rows = [(1, "ab"), (2, "ab"), (3, "b"), (4, "ab"), (5, None), (6, "")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    want = []
    for prefix in "ab":
        found = sorted((t[p:], d, p) for d, t in rows for p in range(len(t or "")) if t[p] == prefix)
        for k, (x, d, p) in enumerate(found):
            want.append((prefix, k, d, p, len(os.path.commonprefix([x, found[k - 1][0]])) if k else 0))
    got = queries.QUERIES["suffix_array_part"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("prefix", "rank", "doc_id", "pos", "lcp").collect()) == sorted(want)
