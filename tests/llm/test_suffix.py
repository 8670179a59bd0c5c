from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from lexigrove.llm import suffix

SCHEMA = "doc_id long, text string, extra string"


def brute(rows, length=suffix.LENGTH):
    """Per id the places of first and of later occurrences of windows that occur more than once."""
    seen = defaultdict(list)
    for key, text, *_ in rows:
        if key is None or text is None:
            continue
        w = text.split()
        for p in range(len(w) - length + 1):
            seen[tuple(w[p : p + length])].append((key, p))
    first, later = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            least = min(places)
            for key, p in places:
                (first if (key, p) == least else later)[key].update(range(p, p + length))
    return first, later


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    shared, short = text(70), text(49)
    rows = []
    for i in range(30):
        body = text(r.randrange(0, 160))
        if i % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = shared
        if i % 4 == 1:
            body += short
        rows.append([i, " ".join(body), "x"])
    rows += [[100, " ".join(["again"] * 300), "x"], [101, " ".join(text(20) * 9), "x"], [102, " ".join(text(60) * 2), "x"]]
    rows += [[103, rows[5][1], "x"], [104, "", "x"], [105, None, "x"], [None, " ".join(shared), None], [106, "\n ".join(shared + shared[:55]), "x"]]
    rows += [[107, " ".join(text(30000) + shared), "x"]]
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus()
    return rows, suffix.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()


def test_spans_equal_brute_force(found):
    rows, spans = found
    first, later = brute(rows)
    for which, flag in ((first, True), (later, False)):
        got = defaultdict(set)
        for s in spans:
            if s.first == flag:
                assert not got[s.doc_id] & set(range(s.start_word, s.end_word))
                got[s.doc_id].update(range(s.start_word, s.end_word))
        assert got == which


def test_origin_is_an_earlier_document(found):
    _, spans = found
    assert all(s.first_doc_id <= s.doc_id for s in spans)
    assert any(s.first_doc_id < s.doc_id for s in spans)


def test_nothing_without_repeats(spark):
    assert suffix.repeated_spans(spark.createDataFrame([[1, "a b c", ""], [2, "a b c", ""]], SCHEMA)).count() == 0
    assert suffix.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    assert suffix.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage_takes_out_later_occurrences(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [[1, f"one {passage} end", 3, "a", "b", "c"], [2, f"two\n{passage}\tend  too", 3, "a", "b", "c"], [3, passage, 3, "a", "b", "c"], [4, None, None, None, None, None], [5, "", 0, "", "", ""], [None, passage, 1, "a", "b", "c"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, cut_spans string, name string, first string")
    out = {r.doc_id: r for r in suffix.suffix_dedup(docs).collect()}
    assert docs.columns == suffix.suffix_dedup(docs).columns
    assert out[1].text == rows[0][1] and out[1].n_chars == len(rows[0][1])
    assert out[2].text == "two\ntoo" and out[2].n_chars == 7
    assert 3 not in out
    assert out[4].text is None and out[5].text == "" and out[None].text == passage


def test_repeated_rows_count_as_one_document(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([[1, passage, "a"], [1, passage, "b"], [2, passage, "c"]], SCHEMA)
    assert sorted((r.doc_id, r.extra) for r in suffix.suffix_dedup(docs).collect()) == [(1, "a"), (1, "b")]


def test_removable():
    assert suffix.removable([(0, 50, True), (30, 90, False), (100, 150, False)]) == [(50, 90), (100, 150)]
    assert suffix.removable([(40, 60, True), (0, 100, False)]) == [(0, 40), (60, 100)]


def test_nested_passages_leave_no_window_twice(spark):
    run = lambda c, n: [f"{c}{i}" for i in range(n)]
    p, x, y, z = run("p", 98), run("x", 3), run("y", 2), run("z", 60)
    texts = [run("a", 5) + p, x + p + y, x + p + y + run("c", 4), z + x + p, z + x + p + y, p[:30] + run("d", 55) + p[30:], p[:30] + p[30:60] + run("d", 55), run("e", 49) + p + z[:30], z[30:] + run("e", 49)]
    rows = [[i, " ".join(t), "x"] for i, t in enumerate(texts)]
    out = suffix.suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    seen = [tuple(w[k : k + suffix.LENGTH]) for w in (r.text.split() for r in out) for k in range(len(w) - suffix.LENGTH + 1)]
    assert len(seen) == len(set(seen))
    assert {r.doc_id: r.text for r in out}[0] == rows[0][1]
    assert {w for t in texts for w in t} == {w for r in out for w in r.text.split()}
    assert suffix.repeated_spans(spark.createDataFrame([tuple(r) for r in out], SCHEMA)).count() == 0


def test_any_number_of_ranges_gives_the_same(spark, found, monkeypatch):
    rows, spans = found
    monkeypatch.setattr(suffix, "RANGE_BYTES", 9_000)
    again = suffix.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, spans))


def test_a_passage_in_most_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [[i, f"{i} {passage} {i}" if i % 3 else f"own{i} " * 3, "x"] for i in range(3000)]
    spans = suffix.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert {tuple(s) for s in spans} == {(1, 1, 61, True, 1)} | {(i, 1, 61, False, 1) for i in range(2, 3000) if i % 3}


def test_texts_of_one_id_are_told_apart(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([[1, f"a {passage}", "a"], [1, f"b b {passage} c", "b"], [2, "d e f", "c"]], SCHEMA)
    assert suffix.repeated_spans(docs).count() == 2
    out = {r.extra: r.text for r in suffix.suffix_dedup(docs).collect()}
    assert sorted(map(len, out.values())) == sorted(map(len, ["d e f", f"a {passage}", "b b c"])) or sorted(map(len, out.values())) == sorted(map(len, ["d e f", "a ", f"b b {passage} c"]))


def test_places_survive_their_bytes():
    r = np.random.default_rng(4)
    p = suffix.Places(np.repeat([-5, 7, 7, 1 << 60], [1, 4, 2, 3]), np.repeat([9, 1, 0xFFFFFFFF, 0], [1, 4, 2, 3]), np.array([3, 0, 1, 900, 70_000, 5, 6, 0, 2, 4]), r.integers(0, 1 << 56, 10))
    q = suffix.Places.from_bytes(p.to_bytes())
    assert all((getattr(p, c) == getattr(q, c)).all() for c in ("id", "tag", "pos", "name"))
