"""The pipeline over a small corpus, each stage held against what it has to do with what the one before it kept."""

from __future__ import annotations

import os

import corpus_pipeline
import pytest
from lexigrove.llm import queries, suffix

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs)
    return [[r.asDict() for r in df.collect()] for df in out], [df.columns for df in out]


def test_stages(spark, stages):
    rows, columns = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "suffix-array dedup", "packing"]
    assert all(c == columns[0] for c in columns[:-1])
    raw, good, single, apart, cut, packed = rows
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0 and any(x["doc_id"] == i for x in raw)]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    # exact: the least id of each text
    least = {}
    for r in good:
        least[r["text"]] = min(r["doc_id"], least.get(r["text"], r["doc_id"]))
    assert sorted(r["doc_id"] for r in single) == sorted(least.values())
    assert {r["doc_id"] for r in apart} <= {r["doc_id"] for r in single}
    # suffix array: no window of the words is left twice over that wasn't kept as a first one
    before = {r["doc_id"]: r["text"].split() for r in apart}
    seen = {}
    for i, w in before.items():
        for p in range(len(w) - suffix.LENGTH + 1):
            seen.setdefault(tuple(w[p : p + suffix.LENGTH]), []).append((i, p))
    later, first = {}, {}
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                (first if (i, p) == min(places) else later).setdefault(i, set()).update(range(p, p + suffix.LENGTH))
    want = {}
    for i, w in before.items():
        left = [x for k, x in enumerate(w) if k not in later.get(i, ()) or k in first.get(i, ())]
        if left or i not in later:
            want[i] = left
    assert {r["doc_id"]: r["text"].split() for r in cut} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    # packing: each word of each document once
    words = sorted((r["doc_id"], k) for r in packed for k in range(r["start_word"], r["end_word"]))
    assert words == sorted((i, k) for i, w in want.items() for k in range(len(w)))


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: sorted(r.items())
    assert sorted((r.asDict() for r in corpus_pipeline.run(spark, SF).collect()), key=key) == sorted(stages[0][-1], key=key)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in rel.fetchall())
