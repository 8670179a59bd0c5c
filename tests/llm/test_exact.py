from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexigrove.llm import exact
from lexigrove.llm.exact import CountingQuotientFilter as Filter
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, fp string, n int"


def built(values, bits):
    c = sorted(Counter(values).items())
    return Filter.build(np.array([v for v, _ in c], np.uint64), np.array([n for _, n in c], np.int64), bits)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**20 - 1) | st.integers(0, 40), min_size=1, max_size=60), min_size=1, max_size=4))
def test_filters_merge_without_loss(parts):
    merged = Filter.merge(Filter.from_bytes(built(p, 20).to_bytes()) for p in parts)
    want = Counter(v for p in parts for v in p)
    values, counts = Filter.from_bytes(merged.to_bytes()).items()
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == want
    for v in [*want, 5, 2**20 - 1]:
        assert merged.count(v) == want[v]


ROWS = [
    (5, "a", "x", 1), (3, "a", "y", 2), (9, "b", None, 3), (1, "", "z", 4), (2, "", "z", 5), (7, None, "q", 6), (8, None, "q", 7), (None, "a", "n", 8), (None, "n", "n", 9), (None, "n", "n", 9),
    (4, "r", "r", 1), (4, "r", "r", 1), (6, "long " * 50_000, "l", 1), (10, "long " * 50_000, "l", 1), (11, "long " * 50_000 + "x", "l", 1), (12, "B", "", 0),
]


def test_groups(spark):
    got = sorted(map(tuple, exact.exact_groups(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()), key=str)
    texts = {}
    for i, t, *_ in ROWS:
        texts.setdefault(t, []).append(i)
    want = []
    for i, t, *_ in ROWS:
        group = [i] if t is None else texts[t]
        known = [x for x in group if x is not None]
        keep = i if len(group) == 1 else min(known) if known else None
        want.append((i, keep, len(group), i == keep))
    assert got == sorted(want, key=str)


def test_dedup_keeps_one_row_of_each_text_with_its_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = exact.exact_dedup(docs.repartition(3))
    assert out.columns == docs.columns
    rows = [tuple(r) for r in out.collect()]
    assert all(r in ROWS for r in rows)
    assert Counter(r[1] for r in rows) == {t: (2 if t is None else 1) for t in {r[1] for r in ROWS}}
    assert {r[1]: r[0] for r in rows if r[1]}["a"] == 3 and {r[1]: r[0] for r in rows}[""] == 1


def test_clashing_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact.F, "xxhash64", lambda *_: F.lit(77).cast("long"))
    got = {r.doc_id: (r.keep_id, r.copies) for r in exact.exact_groups(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id long, text string")).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1)}
    assert sorted(r.doc_id for r in exact.exact_dedup(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")).collect()) == [1, 2]


@pytest.mark.parametrize("f", [exact.exact_groups, exact.exact_dedup])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_row_kept_does_not_depend_on_the_partitioning(spark):
    rows = [(1, "t", src, n) for src in ("r", "q", "s", None) for n in (3, 2)] + [(None, "u", "b", 1), (None, "u", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {tuple(sorted(map(tuple, exact.exact_dedup(docs.repartition(n, "fp", "n")).collect()), key=str)) for n in (1, 2, 3, 4)}
    assert kept == {((1, "t", "q", 2), (None, "u", "a", 1))}


def test_more_slices_than_partitions(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('t', id % 1000) as text")
    lean = docs.selectExpr("xxhash64(text) as fp")
    assert exact.repeated_fingerprints(lean, 1 << 26).groupBy("n").count().collect() == [(3, 1000)]
