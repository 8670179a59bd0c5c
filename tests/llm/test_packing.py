from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from lexigrove.llm import packing


def loads(sizes, k):
    return np.bincount(packing.differencing(np.array(sizes), k), weights=sizes, minlength=k)


def test_textbook_examples():
    assert sorted(loads([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert sorted(loads([5, 5, 5, 4, 4, 3, 3, 1], 3)) == pytest.approx([10, 10, 10], abs=1)


@pytest.mark.parametrize("seed", range(8))
def test_near_the_optimum(seed):
    r = random.Random(seed)
    sizes, k = [r.randrange(1, 60) for _ in range(8)], 3
    best = min(max(sum(s for s, w in zip(sizes, ws) if w == j) for j in range(k)) for ws in itertools.product(range(k), repeat=8))
    got = loads(sizes, k)
    assert got.sum() == sum(sizes) and got.max() <= best * 4 / 3


@pytest.mark.parametrize("n,k", [(0, 3), (1, 3), (3, 3), (2, 5), (200, 7), (500, 40)])
def test_every_piece_has_a_window_and_loads_are_near_equal(n, k):
    r = np.random.default_rng(n)
    sizes = r.integers(1, 300, n)
    where = packing.differencing(sizes, k)
    assert len(where) == n and (n == 0 or (0 <= where.min() and where.max() < k))
    if n >= 200:
        load = np.bincount(where, weights=sizes, minlength=k)
        assert load.max() - load.min() <= 0.02 * load.mean()


def test_windows_rise_until_nothing_is_over():
    for sizes in ([6] * 10, [10, 10, 5, 5, 1], [4, 4, 4], [3] * 7, [9, 2, 2, 2, 2]):
        sizes = np.array(sizes)
        where = packing.pack_group(sizes, 10)
        assert np.bincount(where, weights=sizes).max() <= 10
    assert packing.pack_group(np.array([4, 4, 4]), 10).max() == 1


SCHEMA = "doc_id long, text string, bin string, slot int"


def check(rows, out, capacity):
    want = [(d, w) for d, t in rows for w in range(len((t or "").split()))]
    got = [(r.doc_id, w) for r in out for w in range(r.start_word, r.end_word)]
    assert sorted(got, key=str) == sorted(want, key=str)
    windows = {}
    for r in out:
        windows.setdefault(r.window_id, []).append(r)
    for rs in windows.values():
        load = sum(r.end_word - r.start_word + 1 for r in rs)
        assert load <= capacity and {r.window_load for r in rs} == {load}
        assert sorted(r.slot for r in rs) == list(range(len(rs)))


@pytest.mark.parametrize("capacity", [2, 16, 300])
def test_each_word_once(spark, capacity):
    r = random.Random(capacity)
    rows = [(i, " ".join("w" * r.randrange(0, 90))) for i in range(60)] + [(None, "a b"), (3, "a  b\nc"), (3, "a  b\nc"), (70, ""), (71, None), (72, "x " * 5000)]
    docs = spark.createDataFrame([(*x, "b", 1) for x in rows], SCHEMA)
    out = packing.pack(docs, capacity=capacity).collect()
    check(rows, out, capacity)
    again = packing.pack(docs.repartition(7), capacity=capacity).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(out, key=key) == sorted(again, key=key)


def test_empty_table_and_bad_capacity(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack(docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, capacity=1)


@pytest.mark.parametrize("key", [None, 7])
def test_rows_without_or_with_one_id_are_spread(spark, key):
    docs = spark.range(200_000).selectExpr(f"cast({'null' if key is None else key} as long) as doc_id", "repeat('w ', int(id % 9) + 1) as text").repartition(4)
    began = time.time()
    out = packing.pack(docs)
    most = out.selectExpr("window_id >> 24 as bin", "window_id", "window_load").groupBy("bin").count().agg({"count": "max"}).first()[0]
    assert most < 30_000 and out.agg({"window_load": "max"}).first()[0] <= packing.CAPACITY and time.time() - began < 90
