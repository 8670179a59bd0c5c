from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from lexigrove.llm import quality

SCHEMA = "doc_id long, text string, label_id string, quality int"


def make(n, seed=3):
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "von") for b in ("ra", "sel", "tin", "dor", "pa", "mu")]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(20, 200))]
        kind = i % 4
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["scumword", "vilething"]))
        docs.append((i, " ".join(words).capitalize() + ".", "x", 1))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = make(600)
    known = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, quality int, toxic int")
    return labels, {r.doc_id: r for r in quality.score(spark.createDataFrame(docs, SCHEMA).repartition(4), known).collect()}, known


def test_held_out_accuracy(scored):
    labels, got, _ = scored
    held = [(got[i].keep, q == 1 and t == 0) for i, q, t in labels if i >= 400]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    good = [got[i].keep for i, q, t in labels if i >= 400 and q and not t]
    assert sum(good) >= 0.97 * len(good)


def test_stage_keeps_what_score_keeps(spark, scored):
    _, got, known = scored
    docs = spark.createDataFrame(make(600)[0], SCHEMA)
    out = quality.keep_good(docs, known)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, r in got.items() if r.keep)


def test_nulls_and_repeats(spark, scored):
    _, _, known = scored
    docs, labels = make(600)
    rows = [*docs, (None, docs[0][1], None, None), (0, docs[0][1], None, None), (900, None, None, None), (901, "", None, None), (902, " \n", None, None), (903, "ka ra " * 100_000, None, None)]
    out = quality.score(spark.createDataFrame(rows, SCHEMA), known).collect()
    assert len(out) == len(rows)
    same = {(r.probability, r.keep) for r in out if r.doc_id in (None, 0)}
    assert len(same) == 1
    assert all(r.probability == 0 and not r.keep for r in out if r.doc_id in (900, 901, 902))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", "", 1), (2, None, "", 1)], SCHEMA)
    for rows in ([], [(1, 1, 0)], [(1, None, None), (None, 0, 0)]):
        known = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert sorted(map(tuple, quality.score(docs, known).collect())) == [(1, None, True), (2, 0.0, False)]
    assert quality.score(spark.createDataFrame([], SCHEMA), known).count() == 0


def test_partition_sums_equal_the_whole(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(300, len(quality.STATISTICS))), r.integers(0, 2, 300)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    df = spark.createDataFrame([(a.tolist(), bool(b)) for a, b in zip(x, y, strict=True)], "stats array<double>, good boolean").repartition(5)
    rows = df.mapInArrow(quality._normal_equations(mean, scale), "row long, sums array<double>").groupBy("row").applyInArrow(quality._add, "row long, sums array<double>").orderBy("row").collect()
    phi = quality.fourier((x - mean) / scale)
    assert np.allclose([r.sums for r in rows], phi.T @ np.hstack([phi, y[:, None]]))


def test_features_approximate_the_kernel():
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 6))
    phi = quality.fourier(x, 4096)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(phi @ phi.T - np.exp(-distance / 2 / 6)).max() < 0.1


def test_isotonic_is_the_monotone_least_squares_fit():
    r = np.random.default_rng(7)
    score = np.round(r.normal(size=60), 1)
    good = (r.random(60) < 1 / (1 + np.exp(-score))).astype(float)
    at, p = quality.isotonic(score, good)
    assert (np.diff(p) >= 0).all() and (np.diff(at) > 0).all()
    # the classical minimax form: at each score the max over lower bounds of the min over upper bounds of means
    xs = np.unique(score)
    mean = lambda a, b: good[(score >= a) & (score <= b)].mean()
    want = [max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs]
    assert np.allclose(np.interp(xs, at, p), want)


def test_statistics_of_one_text_do_not_depend_on_its_neighbours():
    lexicon = quality.Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    texts = ["a b a b\nc", "", "ÉTÉ!! 12 12", None, "x\nx\ny"]
    together, filled = quality.statistics(pa.array(texts), lexicon)
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array([t], pa.string()), lexicon)[0][0], together[i])
    assert filled.tolist() == [True, False, True, False, True]
    column = {n: together[:, i] for i, n in enumerate(quality.STATISTICS)}
    assert column["distinct"][0] == 3 / 5 and column["most_frequent"][0] == 2 / 5
    assert column["distinct_lines"][4] == pytest.approx(2 / 3)


def test_scores_equal_a_plain_fit(spark):
    """The whole of it again, text by text: lexicon by sets, one matrix, the minimax form of the calibration."""
    docs, labels = make(260, seed=8)
    docs += [(1000, None, "", 0), (1001, "", "", 0)]
    known = [x for x in labels if x[0] < 200] + [(3, 0, 0), (7, None, 1), (None, 1, 0)]
    table = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.probability for r in quality.score(spark.createDataFrame(docs, SCHEMA).repartition(3), table).collect()}

    text = {i: t for i, t, *_ in docs}
    good, toxic = {}, {}
    for i, q, t in known:
        if i is not None and q is not None:
            good[i] = min(good.get(i, 1), int(q == 1 and not t))
            toxic[i] = max(toxic.get(i, 0), t)
    held = {r.i for r in spark.createDataFrame([(i,) for i in good], "i long").where(f"pmod(xxhash64(i, {quality.SEED}), {quality.HELD_OUT}) = 0").collect()}
    fitted, kept_back = [i for i in good if i not in held], [i for i in good if i in held]

    def codes(t):
        raw, offsets = quality.words.text_buffer(pa.array([t]))
        soft = quality.folded(raw)
        start, end, _ = quality.words.word_spans(soft, offsets)
        return [set(c.tolist()) for c in quality.lexical_codes(soft, start, end)]

    bad_of, good_of = {}, {}
    for i in fitted:
        for some in codes(text[i]):
            for c in some:
                side = bad_of if toxic[i] else good_of
                side[c] = side.get(c, 0) + 1
    n_bad = sum(toxic[i] for i in fitted)
    n_good = len(fitted) - n_bad
    weight = {}
    for c in {*bad_of, *good_of}:
        b, g = bad_of.get(c, 0), good_of.get(c, 0)
        if b + g >= quality.LEAST_DOCS:
            share = (b + g) / len(fitted)
            odds = np.log((b + 8 * share) / (n_bad + 8)) - np.log((g + 8 * share) / (n_good + 8))
            if odds >= quality.LEAST_ODDS:
                weight[c] = odds
    code = np.array(sorted(weight), np.uint64)
    lexicon = quality.Lexicon(code, np.array([weight[int(c)] for c in code]))
    stats = {i: quality.statistics(pa.array([t]), lexicon)[0][0] for i, t in text.items() if t}
    x = np.array([stats[i] for i in fitted])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    phi = lambda ids: quality.fourier((np.array([stats[i] for i in ids]) - mean) / scale)
    a = phi(fitted)
    penalty = np.diag([quality.RIDGE] * quality.FEATURES + [1e-9])
    w = np.linalg.solve(a.T @ a + penalty, a.T @ np.array([good[i] for i in fitted], float))
    s, y = np.round(phi(kept_back) @ w, 9), np.array([good[i] for i in kept_back], float)
    xs = np.unique(s)
    level = [max(min(y[(s >= lo) & (s <= hi)].mean() for hi in xs if hi >= v) for lo in xs if lo <= v) for v in xs]
    for i in text:
        want = float(np.interp(phi([i]) @ w, xs, level)[0]) if text[i] else 0.0
        assert got[i] == pytest.approx(want, abs=1e-4)
