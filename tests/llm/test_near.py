from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from lexigrove.llm import near

SCHEMA = "doc_id long, text string, bands int, near_key string"


def shingles(text):
    w = re.findall(r"[^\s!-/:-@\[-`{-~]+", text.lower())
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 0


def corpus():
    r = random.Random(11)
    vocabulary = [f"wörd{i}" for i in range(900)]
    rows, key = [], 0
    for n in (3, 12, 60, 300, 900):
        for _ in range(6):
            words = [r.choice(vocabulary) for _ in range(n)]
            rows.append((key, " ".join(words)))
            key += 1
            for rate in (0.0, 0.02, 0.05, 0.1, 0.3):
                rows.append((key, " ".join(r.choice(vocabulary) if r.random() < rate else w for w in words).title() + "!"))
                key += 1
    rows += [(key + i, "copy of one text " * 40 + f"end{i % 3}") for i in range(60)]
    return rows


def components(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_groups_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.group_id for r in near.near_groups(spark.createDataFrame([(*x, 1, "k") for x in rows], SCHEMA).repartition(5)).collect()}
    assert got.keys() == {i for i, _ in rows}
    sure = [(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= near.THRESHOLD]
    caught = sum(got[a] == got[b] for a, b in sure)
    assert len(sure) > 100 and caught >= 0.9 * len(sure)
    possible = components([(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= near.THRESHOLD - 0.15], list(got))
    assert all(possible[i] == possible[g] and g <= i for i, g in got.items())


def test_estimates_follow_similarity():
    r = random.Random(4)
    errors = []
    for overlap in (0.6, 0.75, 0.9, 0.98):
        for _ in range(20):
            common = [r.random() for _ in range(int(2000 * overlap))]
            a, b = (common + [r.random() for _ in range((2000 - len(common)) // 2)] for _ in range(2))
            grams = np.array([hash(x) & (2**64 - 1) for x in a + b], np.uint64)
            _, values = near.minhash(np.repeat([0, 1], [len(a), len(b)]), grams, 2)
            s = near.odd_sketches(values).view(np.uint64)
            true = len(set(a) & set(b)) / len(set(a) | set(b))
            errors.append(float(near.similarity(np.bitwise_count(s[0] ^ s[1]).sum())) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_linked_is_single_linkage():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, (4, 8)).astype(np.uint64)
    maps = np.concatenate([base[[i % 4]] ^ np.array([[1 << (i % 60)] + [0] * 7], np.uint64) for i in range(40)])
    ids = r.permutation(40)
    a, b = near.linked(ids, maps, 3)
    label = dict(zip(a.tolist(), b.tolist(), strict=True))
    groups = {i: min(int(ids[j]) for j in range(40) if j % 4 == k % 4) for k, i in enumerate(ids.tolist())}
    assert {i: label.get(i, i) for i in ids.tolist()} == groups


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(900, 800)], "a long, b long")
    got = {r.id: r.group_id for r in near.components(edges).collect()}
    assert {k: v for k, v in got.items() if v != k} == {i: 0 for i in range(1, n + 1)} | {900: 800}


def test_edge_cases(spark):
    rows = [(1, "", 0, ""), (2, None, 0, ""), (3, "  ... ", 0, ""), (4, "one", 0, ""), (5, "One!", 0, ""), (None, "one", 0, ""), (6, "a b c d", 0, ""), (6, "a b c d", 0, ""), (7, "x " * 60000 + "y", 0, ""), (8, "x " * 60000 + "y", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, near.near_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (None, None, True), (6, 6, True), (6, 6, True), (7, 7, True), (8, 7, False)], key=str)
    kept = near.near_dedup(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, None, 6, 6, 7], key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert near.near_groups(empty).count() == 0 and near.near_dedup(empty).count() == 0


def test_shingles_fold_case_and_punctuation():
    row, grams = near.shingles(pa.array(["Été, DE la Mer", "été de   LA mer!", None, "solo"]))
    assert row.tolist() == [0] * 3 + [1] * 3 + [3]
    assert grams[:3].tolist() == grams[3:6].tolist()


def test_pieces_of_buckets_give_the_same_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(*x, 1, "k") for x in corpus()], SCHEMA).repartition(3)
    want = sorted(map(tuple, near.near_groups(docs).collect()))
    monkeypatch.setattr(near, "PIECE", 2)
    assert sorted(map(tuple, near.near_groups(docs).collect())) == want


def test_rows_of_bands_are_moved_once(spark, monkeypatch):
    n = 300
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30)), 1, "k") for i in range(n)], SCHEMA).repartition(4)
    sketched = near.cut(near.sketches(docs))
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    monkeypatch.setattr(near, "checked_broadcast", lambda small, *_: small)
    before, limit = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert near.near_edges(sketched).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert near.BANDS * n <= moved() - before < 1.5 * near.BANDS * n
