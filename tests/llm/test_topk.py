from __future__ import annotations

import numpy as np
import pytest
from lexigrove.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank int, id string"


def brute(vectors, k):
    out = []
    for i, x in vectors.items():
        scored = sorted((-round(float(np.dot(x, y)), topk.DIGITS), j) for j, y in vectors.items() if j != i)
        out += [(i, n + 1, j, round(float(np.dot(x, vectors[j])), 6) + 0.0) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(v) for v in x], 0, "i") for i, x in vectors.items()], SCHEMA)


@pytest.mark.parametrize("case", ["clusters", "unit", "lengths", "ties", "one"])
def test_equals_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 64)
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 16)).astype(np.float32)
    if case == "clusters":
        x = (x[r.integers(0, 6, 400)] + 0.1 * x).astype(np.float32)
    if case == "unit":
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    if case == "lengths":
        x *= np.exp(r.normal(size=(400, 1)) * 2).astype(np.float32)
    if case == "ties":
        x = np.repeat(x[:40], 10, axis=0)
        x[:5] = 0
    if case == "one":
        x = x[:, :1]
    ids = r.permutation(400) * 7 - 50
    vectors = {int(i): v.astype(np.float64) for i, v in zip(ids, x, strict=True)}
    assert sorted(map(tuple, topk.top_k(frame(spark, vectors).repartition(5), k=10).collect())) == brute(vectors, 10)


def test_blocks_are_pruned():
    r = np.random.default_rng(1)
    x = r.normal(size=(5000, 16)) * np.exp(-np.arange(16))
    x *= np.linspace(3, 0.1, 5000)[:, None] / np.linalg.norm(x, axis=1, keepdims=True)
    search = topk.Search(np.arange(50), x[:50], 5)
    for a in range(0, 5000, 500):
        block = x[a : a + 500]
        if search.done(np.linalg.norm(block[0])):
            break
        search.offer(np.arange(a, a + 500), block, [np.sqrt((block[:, s:] ** 2).sum(axis=1)) for s in search.splits], np.linalg.norm(block[0]))
    assert a < 4500 and search.pairs < 50 * 5000 / 4


def test_what_is_left_out(spark):
    good = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [1.0, 1.0]}
    rows = [(i, v, 0, "x") for i, v in good.items()] + [(None, [9.0, 9.0], 0, "x"), (4, None, 0, "x"), (5, [], 0, "x"), (6, [1.0], 0, "x"), (7, [1.0, None], 0, "x"), (8, [1.0, float("nan")], 0, "x"), (9, [1.0, float("inf")], 0, "x"), (3, [0.5, 9.0], 0, "x"), (3, [1.0, 1.0], 0, "x"), (3, [7.0], 0, "x")]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute({k: np.array(v) for k, v in good.items()}, 10)
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.top_k(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([], SCHEMA), k=0)


@pytest.mark.parametrize("step", [1, 3])
def test_each_length_is_searched_apart(spark, step):
    r = np.random.default_rng(5)
    groups = [{i: r.normal(size=w) for i in range(w, 90, 3)} for w in (3, 4, 5)]
    want = [row for g in groups for row in brute({i: np.float32(v).astype(float) for i, v in g.items()}, 10) if row[0] % step == 0]
    assert sorted(map(tuple, topk.top_k(frame(spark, {i: v for g in groups for i, v in g.items()}), query_step=step).collect())) == sorted(want)
