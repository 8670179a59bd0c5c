from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from lexigrove.llm import lm


def words(text):
    return re.findall(r"[^\s!-/:-@\[-`{-~]+", (text or "").lower())


def brute(texts, corpus, alpha=1.0, own=0):
    docs = [words(t) for t in corpus]
    total = sum(map(len, docs)) - own

    def count(gram):
        n = len(gram)
        return sum(d[i : i + n] == gram for d in docs for i in range(len(d) - n + 1)) - own

    out = []
    for key, text in texts:
        w = words(text)
        logs, contexts = [], []
        for i in range(len(w)):
            p = (count([w[i]]) + alpha / (total + 1)) / (total + alpha)
            longest = max((n for n in range(1, i + 1) if count(w[i - n : i])), default=0)
            if longest:
                p = (count(w[i - longest : i + 1]) + alpha * p) / (count(w[i - longest : i]) + alpha)
            logs.append(math.log(p))
            contexts.append(longest)
        n = len(w)
        out.append((key, n, round(sum(logs), 6) + 0.0, math.exp(-sum(logs) / n) if n else None, sum(contexts) / n if n else None, max(contexts) if n else None))
    return out


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=str), sorted(b, key=str), strict=True):
        assert x[:2] == y[:2] and x[5] == y[5]
        for u, v in zip(x[2:5], y[2:5], strict=True):
            assert (u is None and v is None) or u == pytest.approx(v, abs=2e-6, rel=1e-6)


@pytest.mark.parametrize("shard", [7, 100, 10**6])
def test_scores_against_brute_force(spark, shard):
    r = random.Random(8)
    make = lambda n: " ".join(r.choice(["a", "b", "c", "D,", "é"]) for _ in range(n))
    corpus = [make(r.randrange(0, 25)) for _ in range(25)] + ["a b c " * 6, None, "", "a b c " * 6, "!!! ..."]
    texts = [(i, make(r.randrange(1, 12))) for i in range(10)] + [(20, "a b c " * 5), (21, None), (22, ""), (None, "a é"), (23, "zzz a zzz"), (20, "a b c " * 5), (24, corpus[3])]
    c = spark.createDataFrame([(t, 1, "x") for t in corpus], "text string, query int, word string").repartition(4)
    t = spark.createDataFrame([(*x, 7) for x in texts], "item_id long, text string, n_words int").repartition(3)
    close([tuple(x) for x in lm.score(t, c, shard_words=shard).collect()], brute(texts, corpus))


def test_empty_tables(spark):
    t = spark.createDataFrame([], "item_id long, text string")
    c = spark.createDataFrame([], "text string")
    assert lm.score(t, c).count() == 0
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    close([tuple(x) for x in lm.score(one, c).collect()], brute([(1, "a b")], []))
    assert lm.score(t, spark.createDataFrame([("a",)], "text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    a = r.integers(0, [2, 3, 50][seed % 3], 300)
    depth = [4, 300, 20][seed // 2]
    order = lm.suffix_array(a, depth)
    assert sorted(order.tolist()) == list(range(300))
    keys = [tuple(a[i : i + depth].tolist()) for i in order]
    assert keys == sorted(keys)


@pytest.mark.parametrize("shard", [7, 10**6])
def test_documents_are_scored_without_the_scored_occurrence(spark, shard):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["a", "b", "c", "D,", "é"]) for _ in range(r.randrange(0, 15)))) for i in range(15)]
    rows += [(20, "a b c " * 4), (21, None), (22, "only here"), (23, "a b c " * 4), (24, "a a a a a")]
    t = spark.createDataFrame([(*x, 5) for x in rows], "item_id long, text string, key int").repartition(3)
    want = brute(rows, [x for _, x in rows], own=1)
    close([tuple(x) for x in lm.score(t, t, shard_words=shard, own_col="item_id").collect()], want)
    some = t.where("item_id % 2 = 0")
    close([tuple(x) for x in lm.score(some, t, shard_words=shard, own_col="item_id", text_words=20).collect()], [x for x in want if x[0] % 2 == 0])


def test_rows_of_one_id_and_text_are_one_document(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c"), (None, "a b"), (1, "b c x")]
    t = spark.createDataFrame(rows, "item_id long, text string").coalesce(1)
    got = {(r.item_id, r.n_words, r.longest_context, r.mean_context) for r in lm.score(t, t, own_col="item_id").collect()}
    assert got == {(1, 4, 3, 1.5), (2, 3, 2, 1.0), (None, 2, 1, 0.5), (1, 3, 2, 1.0)}


def test_a_long_copy(spark):
    r = np.random.default_rng(3)
    long = " ".join(f"w{x}" for x in r.integers(0, 5000, 20_000))
    t = spark.createDataFrame([(1, long), (2, "x " + long), (3, "w1 w2")], "item_id long, text string").repartition(2)
    out = {x.item_id: x for x in lm.score(t, t, own_col="item_id").collect()}
    assert out[1].longest_context == 19_999 and out[2].longest_context == 19_999 and out[3].longest_context <= 1


def test_the_corpus_is_read_once_however_many_texts(spark):
    r = random.Random(12)
    rows = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(10))) for i in range(1500)] + [(2000 + i, "a passage that two texts have in common " + str(i)) for i in range(40)]
    t = lm.cut(spark.createDataFrame(rows, "item_id long, text string").repartition(3))
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def rows_read():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))

    some = t.where("item_id % 100 = 0")
    before = rows_read()
    got = [tuple(x) for x in lm.score(some, t, shard_words=2000, own_col="item_id", text_words=20).collect()]
    assert rows_read() - before < 4 * len(rows)
    assert {x[0]: x[5] for x in got}[2000] == 8
    few = [x for x in rows if x[0] in (0, 100, 2000)]
    close([x for x in got if x[0] in (0, 100, 2000)], brute(few, [x for _, x in rows], own=1))


@pytest.mark.parametrize("n", [4, 5, 6, 15])
def test_passages_at_the_bound_of_short_runs(spark, n):
    words_ = [f"p{i}" for i in range(n)]
    rows = [(1, " ".join(["x1", *words_, "y1"])), (2, " ".join(["x2", *words_, "y2", *words_])), (3, " ".join(words_)), (3, " ".join(words_)), (4, " ".join(words_[1:])), (None, " ".join(words_)), (5, "z"), (6, " ".join(["x1", *words_[:-1]]))]
    t = spark.createDataFrame(rows, "item_id long, text string").repartition(3)
    got = [tuple(x) for x in lm.score(t, t, own_col="item_id", shard_words=2 * n, text_words=2 * n).collect()]
    corpus = [x for _, x in rows]
    for own, pick in ((1, (1, 2, 4, 5, 6)), (2, (3,)), (0, (None,))):
        want = brute([x for x in rows if x[0] in pick], corpus, own=own)
        if own == 1:
            close([x for x in got if x[0] in pick], want)
        else:
            assert sorted(x[5] for x in got if x[0] in pick) == sorted(x[5] for x in want)
