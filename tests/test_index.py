from __future__ import annotations

import itertools
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from lexigrove.functions import ranges, sizing, symbols
from lexigrove.operators import allocate, block, mapped, prefixes, search, suffixes, tree, trie
from lexigrove.plans.engine import Jobs, NotFound, NotReady, SuffixIndex
from lexigrove.sources import corpus as corpora

NAMES = "doc_id long, name string, text string"


def corpus(spark, *texts):
    return spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate(texts)], NAMES)


def built(spark, *texts, **options):
    return SuffixIndex.build(corpus(spark, *texts), sizing.IndexConfig(**options))


def shown(s):
    return s.replace("\ue000", "#").replace("\ue001", "$")


def arrays(index):
    out = {}
    for r in sorted(index.suffixes.collect(), key=lambda r: (r.prefix, r.rank)):
        out.setdefault(shown(r.prefix), []).append((r.pos, r.lcp))
    return out


def test_banana_as_one_string(spark):
    index = built(spark, "banana", boundary="superstring")
    assert arrays(index) == {"a": [(5, 0), (3, 1), (1, 3)], "b": [(0, 0)], "n": [(4, 0), (2, 2)], "$": [(6, 0)]}
    s = index.stats.first()
    assert (s.total_nodes, s.total_edges, s.max_depth, s.total_suffixes, s.s_prefixes, s.final_window_size) == (14, 10, 7, 7, 4, 1)
    edges = {(r["from"], r.to, r.start, r.end) for r in index.edges.where("prefix = 'a'").collect()}
    assert edges == {(0, 2, 5, 6), (2, 1, 6, 7), (2, 4, 4, 6), (4, 3, 6, 7), (4, 5, 4, 7)}
    assert [(r.node_id, r.depth, r.type) for r in index.nodes.where("prefix = 'n'").orderBy("node_id").collect()] == [(0, 0, "root"), (1, 3, "leaf"), (2, 2, "internal"), (3, 5, "leaf")]


def test_two_texts_as_one_string(spark):
    index = built(spark, "Hello", "world", boundary="superstring")
    got = arrays(index)
    assert got["l"] == [(9, 0), (2, 1), (3, 1)] and got["o"] == [(4, 0), (7, 1)] and len(got) == 9
    s = index.stats.first()
    assert (s.total_nodes, s.total_edges, s.max_depth, s.total_suffixes) == (23, 14, 12, 12)


def test_equal_texts(spark):
    joined = arrays(built(spark, "ab", "ab", "ab", boundary="superstring"))
    assert joined["a"] == [(6, 0), (3, 2), (0, 5)] and joined["b"] == [(7, 0), (4, 1), (1, 4)]
    apart = built(spark, "ab", "ab", "ab")
    rows = apart.suffixes.where("prefix = 'a'").orderBy("rank").collect()
    assert [(r.doc_id, r.pos, r.lcp) for r in rows] == [(0, 0, 0), (1, 0, 2), (2, 0, 2)]
    assert [r.lcp for r in apart.suffixes.where("prefix = 'b'").orderBy("rank").collect()] == [0, 1, 1]


def test_split_of_an_edge_to_an_inner_node(spark):
    index = built(spark, "abcXabcYad", boundary="superstring")
    edges = {(r["from"], r.to, r.start, r.end) for r in index.edges.where("prefix = 'a'").collect()}
    assert edges == {(0, 4, 0, 1), (4, 2, 1, 3), (2, 1, 3, 11), (2, 3, 7, 11), (4, 5, 9, 11)}


def test_a_separator_in_a_text_is_an_error(spark):
    with pytest.raises(ValueError):
        corpora.superstring(corpus(spark, "a\ue000b"))


def texts_of(seed):
    r = random.Random(seed)
    alphabet = ["ab", "abc \n", "éта€😀a", "a"][seed % 4]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 40))) for _ in range(6)] + ["", "abab", "abab"]


@pytest.mark.parametrize("seed", range(4))
def test_index_properties(spark, seed):
    texts, limit = texts_of(seed), 100
    index = built(spark, *texts, memory_limit=limit, complete=seed % 2 == 1)
    found = {r.prefix: r for r in index.prefixes.collect()}
    assert all(r.frequency <= limit for r in found.values())
    assert not any(a != b and b.startswith(a) for a, b in itertools.permutations(found, 2))
    characters = sum(map(len, texts))
    gap = index.uncovered.first()
    assert gap.characters == characters and gap.covered == sum(r.frequency for r in found.values()) and gap.uncovered == characters - gap.covered
    nodes, edges = index.nodes.collect(), index.edges.collect()
    assert len(edges) == len(nodes) - len({r.prefix for r in nodes})
    depth = {(r.prefix, r.node_id): r for r in nodes}
    children = {}
    for e in edges:
        assert e.end - e.start == depth[e.prefix, e.to].depth - depth[e.prefix, e["from"]].depth
        symbol = texts[e.doc_id][e.start] if e.start < len(texts[e.doc_id]) else (e.doc_id, "end")
        children.setdefault((e.prefix, e["from"]), []).append(symbol)
    for key, r in depth.items():
        if r.type == "internal":
            assert len(children[key]) >= 2 and len(set(children[key])) == len(children[key])
    by = {}
    for r in sorted(index.suffixes.collect(), key=lambda r: (r.prefix, r.rank)):
        by.setdefault(r.prefix, []).append(r)
    for prefix, rows in by.items():
        keys = [(texts[r.doc_id][r.pos :].encode(), r.doc_id, r.pos) for r in rows]
        assert keys == sorted(keys) and len(set(keys)) == len(keys) == found[prefix].frequency
        assert rows[0].lcp == 0 and [r.rank for r in rows] == list(range(len(rows)))
        for a, b in itertools.pairwise(rows):
            x, y = texts[a.doc_id][a.pos :], texts[b.doc_id][b.pos :]
            common = next((i for i, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
            assert b.lcp == common
        assert sum(r.type == "leaf" and r.prefix == prefix for r in nodes) == len(rows)


def test_complete_covers_every_suffix_but_newlines(spark):
    index = built(spark, "ab" * 80, "b", "a\nb", memory_limit=100, complete=True)
    total, newline = 160 + 1 + 3, 1
    before = 1  # "a" in front of the newline is extended, and its window has the newline
    assert index.prefixes.agg({"frequency": "sum"}).first()[0] >= total - newline - before
    assert index.suffixes.count() == index.prefixes.agg({"frequency": "sum"}).first()[0]


@pytest.mark.parametrize("most", [None, 3])
def test_doubling_equals_the_block(spark, most):
    r = random.Random(5)
    long = "".join(r.choice("ab") for _ in range(300))
    c = corpus(spark, long, long[:200], long[100:], "é😀" * 30, "", "b", "a\0", "a", "a\0b", "\ue001a\ue000", "a\0\0", "\0")
    single = prefixes.window_counts(c, 1)
    rows = lambda s: sorted(map(tuple, suffixes.suffix_array(c, single, s, max_positions=most).collect()))
    assert rows("doubling") == rows("block")
    assert most is None or {x["count"] for x in suffixes.suffix_array(c, single, "block", max_positions=most).groupBy("prefix").count().collect()} <= {1, 2, 3}


@pytest.mark.parametrize("options", [{"memory_limit": 100}, {"memory_limit": 100, "complete": True}, {"boundary": "superstring", "memory_limit": 100}, {"memory_limit": 100, "max_positions": 7}])
def test_a_build_beyond_a_block_is_the_same(spark, monkeypatch, options):
    texts = [*texts_of(0), *texts_of(2), "ab" * 90, "b", "a\0", "a"]
    rows = lambda: {n: sorted(map(tuple, df.collect()), key=str) for n, df in built(spark, *texts, **options).tables().items()}
    block = rows()
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", 10)
    assert rows() == block


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_ranges_equal_the_block(spark, monkeypatch, size):
    """Suffixes of a prefix, and equal ones, may lie in several ranges; texts hold repeats longer than the way to an anchor."""
    monkeypatch.setattr(mapped, "RANGE_SUFFIXES", size)
    monkeypatch.setattr(mapped, "WINDOW", 4)
    monkeypatch.setattr(mapped, "GROUPS", 5)
    monkeypatch.setattr(mapped, "ANCHORS", size)
    r = random.Random(size)
    long = "".join(r.choice("ab\n") for _ in range(300))
    wide = "".join(chr(300 + r.randrange(300)) for _ in range(60))
    for texts in ([long, long[:200], long[100:], "é😀" * 30, "", "b", "a\0", "a", "ab"] + ["ab"] * 20, ["x" * 90, "x" * 70, ""], [wide, wide[10:], wide * 2, *texts_of(2)], [""]):
        c = corpus(spark, *texts)
        single = prefixes.window_counts(c, 1)
        rows = lambda s: sorted(map(tuple, suffixes.suffix_array(c, single, s).collect()))  # noqa: B023, E731
        assert rows("mapped") == rows("block")


def test_a_task_holds_a_range_however_frequent_a_prefix_is(spark, monkeypatch):
    monkeypatch.setattr(mapped, "RANGE_SUFFIXES", 100)
    monkeypatch.setattr(suffixes, "ARRAY_CHARS", 1000)
    monkeypatch.setattr(suffixes, "_in_block", None)
    c = corpus(spark, *["ab"] * 1000)
    sizes, dealt = [], mapped._dealt

    def counted(session, m, names, each, schema):
        one = lambda mine, at: pa.table({"n": pa.array([len(at)], pa.int64())})
        sizes.extend(r.n for r in dealt(session, m, names, one, "n long"))
        return dealt(session, m, names, each, schema)

    monkeypatch.setattr(mapped, "_dealt", counted)
    rows = sorted(map(tuple, suffixes.suffix_array(c, prefixes.window_counts(c, 1)).collect()))
    assert rows == sorted([("a", k, k, 0, 2 * (k > 0)) for k in range(1000)] + [("b", k, k, 1, 1 * (k > 0)) for k in range(1000)])
    assert sum(sizes) == 2000 and max(sizes) <= 300


def test_trees_beyond_a_block_are_never_written_and_the_same(spark, monkeypatch):
    c = corpus(spark, *texts_of(0), *texts_of(2), "ab" * 90)
    want = sorted(map(tuple, tree.tree_stats(built(spark, *(r.text for r in c.orderBy("doc_id").collect())).elements).select("prefix", "leaves", "max_depth").collect()))
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", 10)
    monkeypatch.setattr(suffixes, "index_elements", None)
    monkeypatch.setattr(suffixes, "doubled_ranks", None)
    assert sorted(map(tuple, SuffixIndex.trees(c).collect())) == want


def block_of(texts):
    return block.Block.of(pa.array(range(len(texts))), texts)


@pytest.mark.parametrize("packed", [2, 48])
def test_order_of_a_block(monkeypatch, packed):
    monkeypatch.setattr(block, "PACKED", packed)
    r = random.Random(packed)
    for _ in range(150):
        letters = r.choice(["ab", "abc\0", "aé😀\n", "a"])
        texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, r.choice([5, 40, 200])))) for _ in range(r.randrange(1, 8))]
        texts += [r.choice(texts) for _ in range(3)]
        b = block_of(texts)
        place, lcp = block.suffix_order(b, np.flatnonzero(b.code > 0))
        want = sorted((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t)))
        doc = b.doc(place)
        assert [(int(d), int(p)) for d, p in zip(doc, place - b.begin[doc], strict=True)] == [x[1:] for x in want]
        assert lcp.tolist() == [0] * bool(want) + [len(os.path.commonprefix([x[0], y[0]])) for x, y in itertools.pairwise(want)]


def test_buckets_of_a_block():
    texts = ["banana", "", "ban", "nab\ue001"]
    b = block_of(texts)
    found = block.buckets(b, ["ba", "an", "a\ue001", "n", "zz", "b\ue001", ""], "\ue001")
    at = {(int(b.doc(np.array([p]))[0]), int(p - b.begin[b.doc(np.array([p]))[0]])): int(found[p]) for p in np.flatnonzero(found >= 0)}
    assert at == {(0, 0): 0, (0, 1): 1, (0, 3): 1, (0, 2): 3, (0, 4): 3, (0, 5): 2, (2, 0): 0, (2, 1): 1, (2, 2): 3, (3, 0): 3}
    assert (block.buckets(b, []) == -1).all() and len(block.buckets(block_of([]), ["a"])) == 0


def test_complete_refuses_the_terminator_in_a_text(spark):
    with pytest.raises(ValueError):
        built(spark, "a", "b\ue001c", complete=True)
    assert built(spark, "a", "b\ue001c").suffixes.count() == 4


def test_discovery_is_the_same_for_any_partitioning_and_ends(spark):
    texts = texts_of(1) * 5
    one = prefixes.discover(corpus(spark, *texts).coalesce(1), 20)
    many = prefixes.discover(corpus(spark, *texts).repartition(7), 20)
    assert one[1] == many[1] and sorted(map(tuple, one[0].collect())) == sorted(map(tuple, many[0].collect()))
    with pytest.raises(ValueError):
        prefixes.discover(corpus(spark, "a" * 300), 10, max_window=5)
    assert prefixes.discover(corpus(spark), 10)[0].count() == 0
    assert prefixes.discover(corpus(spark, ""), 10)[0].count() == 0


def test_long_texts_are_cut_without_loss(spark):
    text = "".join(random.Random(2).choice("abcé\n") for _ in range(700))
    for w in (1, 2, 5, 200):
        got = sorted((r.pos, r.prefix) for r in prefixes.windows(corpus(spark, text), w, exclude_newlines=False).collect())
        assert got == [(i, text[i : i + w]) for i in range(len(text) - w + 1)]


def test_compat_widths_and_newlines(spark):
    c = corpus(spark, "éa€😀\nx")
    assert {r.prefix for r in prefixes.windows(c, 1).collect()} == {"é", "a", "€", "😀", "x"}
    assert {r.prefix for r in prefixes.windows(c, 1, compat=True).collect()} == {"a", "€", "x"}


def test_prune_equals_pairwise_comparison(spark):
    strings = ["a", "ab", "abc", "b", "bc", "cab", "ca", "d"]
    df = spark.createDataFrame([(s, 1, len(s)) for s in strings], "prefix string, frequency long, length int")
    want = {s for s in strings if not any(s != t and s.startswith(t) for t in strings)}
    assert {r.prefix for r in prefixes.prune(df).collect()} == want


def test_trie(spark):
    words = [("abc", 2), ("abd", 1), ("b", 4), ("", 3), (None, 1), ("x", 0)]
    t = trie.trie(spark.createDataFrame(words, "prefix string, frequency long"))
    rows = {r.prefix: (r.depth, r.frequency, r.is_terminal, r.is_leaf) for r in t.collect()}
    assert rows == {"a": (1, 3, False, False), "ab": (2, 3, False, False), "abc": (3, 2, True, True), "abd": (3, 1, True, True), "b": (1, 4, True, True)}
    assert {r.prefix for r in trie.prune(t, 3).collect()} == {"a", "b"}
    assert trie.frequency(t, "ab").first()[0] == 3 and trie.frequency(t, "").first()[0] == 0 and trie.frequency(t, "zz").first()[0] == 0
    assert trie.has_prefix(t, "").first()[0] and trie.has_prefix(t, "ab").first()[0] and not trie.has_prefix(t, "zz").first()[0]
    assert {r.prefix for r in trie.collect(t, 2).collect()} == {"ab", "b"}
    assert trie.deserialize(trie.serialize(t)).exceptAll(t).isEmpty()
    some = trie.from_text(corpus(spark, "abcab"), 2, targets=spark.createDataFrame([("a",)], "prefix string"))
    assert {(r.prefix, r.frequency) for r in some.collect()} == {("a", 2), ("ab", 2)}


def test_allocation():
    assert allocate.best_fit_bins([60, 50, 40, 30, 20], 100) == 2
    assert allocate.balance([60, 50, 40, 30, 20], 2, 100) is None
    assert allocate.assign([60, 50, 40, 30, 20], 120, 2) == ([0, 1, 1, 0, 0], 2)
    assert max(allocate.assign([60, 50, 40, 30, 20], 100, 4)[0]) == 2
    assert allocate.assign([], 100, 4) == ([], 0)
    assert allocate.assign([60] * 5, 100, 4) == ([0, 1, 2, 3, 4], 8)
    with pytest.raises(ValueError):
        allocate.assign([200], 100, 2)
    r = random.Random(1)
    for _ in range(20):
        f = sorted((r.randrange(1, 100) for _ in range(60)), reverse=True)
        where, groups = allocate.assign(f, 100, 4)
        assert max(where) < groups
        loads = [sum(x for x, g in zip(f, where, strict=True) if g == k) for k in range(max(where) + 1)]
        assert max(loads) <= 100


def test_places(spark):
    c = corpus(spark, "Hello", "", "world")
    bounds = corpora.boundaries(c, unit="chars")
    assert [(r["index"], r.start, r.end) for r in bounds.orderBy("index").collect()] == [(0, 0, 5), (1, 5, 5), (2, 5, 10)]
    got = {r.pos: (r["index"], r.local) for r in search.position_to_document(spark.createDataFrame([(0,), (4,), (5,), (9,), (10,), (99,), (-1,)], "pos long"), bounds, bucket=2).collect()}
    assert got == {0: (0, 0), 4: (0, 4), 5: (2, 0), 9: (2, 4), 10: (2, 5), 99: (2, 5), -1: (None, None)}


def test_occurrences_overlap(spark):
    c = corpus(spark, "aaaa", "b.aa.b", "", "x")
    want = {("aa", 0, 0), ("aa", 0, 1), ("aa", 0, 2), ("aa", 1, 2), (".", 1, 1), (".", 1, 4)}
    assert {tuple(r) for r in search.occurrences(c, ["aa", ".", "", "zz"]).collect()} == want
    table = spark.createDataFrame([("aa",), (".",), (None,), ("",)], "pattern string")
    assert {tuple(r) for r in search.occurrences(c, table).collect()} == want
    assert search.occurrences(c, []).count() == 0


def test_sizing():
    assert sizing.frequency_limit(0, 1e9, 1e9, 4) == 2048
    assert sizing.frequency_limit(7_218_050, 8e9, 16e9, 12) == 144_361
    assert sizing.frequency_limit(10, 8e9, 16e9, 4) == 50_000
    assert sizing.IndexConfig(memory_limit=5).resolved_limit(10) == 100
    assert sizing.longest_prefix(1000, 100) == 1 and sizing.longest_prefix(256**2 * 10, 10) == 2
    assert sizing.helpful_workers(10, 100) == 2 and sizing.helpful_workers(10**6, 100) == 8
    assert sizing.fits(5, 5) and not sizing.fits(6, 5)
    assert sizing.IndexConfig().resolved_tail(0) == 1


def test_hierarchy_leaves_out_dangling_edges(spark):
    nodes = spark.createDataFrame([("a", 0, 0, "root"), ("a", 1, 2, "internal"), ("a", 2, 3, "leaf")], "prefix string, node_id int, depth int, type string")
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 1, 9)], "prefix string, `from` int, `to` int")
    assert {(r.node_id, r.level, r.path) for r in tree.hierarchy(nodes, edges).collect()} == {(0, 0, "0"), (1, 1, "0/1"), (2, 2, "0/1/2")}


def test_jobs(spark, tmp_path):
    jobs = Jobs()
    key = jobs.submit(corpus(spark, "banana", "bandana"), num_workers=2)
    assert jobs.wait(key, 300)["status"] == "completed"
    assert jobs.summary(key)["stats"]["total_suffixes"] == 13
    assert json.loads(jobs.json(key, "status"))["groupCount"] == jobs.status(key)["group_count"]
    assert json.loads(jobs.json(key))["boundaries"][1]["start"] == 6
    assert json.loads(jobs.json(key, "group", 0))["prefixes"][0]["groupId"] == 0
    with pytest.raises(ValueError):
        jobs.json(key, "no such")
    listed = jobs.groups(key).collect()
    assert sum(r.total_frequency for r in listed) == 13 and listed[0].display_index == listed[0].group_id + 1
    one = jobs.group(key, listed[0].group_id)
    assert one["nodes"].count() == one["edges"].count() + one["prefixes"].count()
    with pytest.raises(NotFound):
        jobs.group(key, 99)
    jobs._result(key).write(str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out/prefixes")).count() == 4
    tables = jobs._result(key).written
    assert all(os.path.isdir(x.removeprefix("file://")) for x in tables)
    jobs.delete(key)
    assert not any(os.path.isdir(x.removeprefix("file://")) for x in tables)
    with pytest.raises(NotFound):
        jobs.status(key)
    bad = jobs.submit(corpus(spark, "a" * 500), memory_limit=100, max_window=3)
    assert jobs.wait(bad, 300)["status"] == "failed"
    with pytest.raises(NotReady):
        jobs.summary(bad)


def test_groups_without_prefixes_are_groups_too(spark):
    jobs = Jobs()
    key = jobs.submit(corpus(spark, *("abcde"[k] * 60 for k in range(5))), num_workers=4, memory_limit=100)
    assert jobs.wait(key, 300)["group_count"] == 8
    listed = jobs.groups(key).collect()
    assert [r.display_index for r in listed] == list(range(1, 9)) and [r.prefix_count for r in listed] == [1] * 5 + [0] * 3
    empty = jobs.group(key, 7)
    assert all(df.count() == 0 for df in empty.values())
    assert [r.group_id for r in jobs.page(key, 0, 2).collect()] == [0, 1] and [r.group_id for r in jobs.page(key, 99).collect()] == [7]
    assert json.loads(jobs.json(key, "groups"))["groupCount"] == 8
    with pytest.raises(NotFound):
        jobs.group(key, 8)


def test_bytes_that_are_not_text_are_left_out(spark):
    c = corpus(spark, "a\ufffdb", "ab")
    assert {(r.prefix, r.frequency) for r in prefixes.window_counts(c, 1).collect()} == {("a", 2), ("b", 2)}
    assert {r.prefix for r in prefixes.windows(c, 2).collect()} == {"ab"}


def test_corpus_info(spark):
    row = corpora.corpus_info(corpus(spark, *("x" * 1000 for _ in range(7)))).first()
    assert (row.texts, row.kilobytes, row.first_names) == (7, 6.84, ["t0", "t1", "t2", "t3", "t4"])


def test_records_of_ranges(spark):
    """compare() agrees with the order of the suffixes, and its record is the one against the smaller."""
    r = random.Random(6)
    text = "".join(r.choice("ab") for _ in range(120)) + "\ue000ab\ue001"
    key = lambda s: [(-2 if c == "\ue001" else -1 if c == "\ue000" else ord(c)) for c in s]
    order = sorted(range(len(text)), key=lambda p: key(text[p:]))

    def against(p, q, size=8):
        n = len(os.path.commonprefix([text[p:], text[q:]]))
        if max(p, q) + n >= len(text):
            return ("\0", "", n)
        return (text[q + n], text[p + n : p + n + size], n)

    rows = []
    for _ in range(200):
        x, y, z = sorted(r.sample(range(len(text)), 3))
        a, b = (order[y], order[z]) if r.random() < 0.5 else (order[z], order[y])
        rows.append((a, against(a, order[x]), b, against(b, order[x]), order[y], order[z]))
    df = spark.createDataFrame(rows, f"a int, ra {ranges.TYPE}, b int, rb {ranges.TYPE}, first int, second int")
    for row in df.select("*", ranges.compare(df.a, df.ra, df.b, df.rb).alias("x")).collect():
        if row.x.record.offset < 0:  # the ranges don't tell
            assert row.ra.offset == row.rb.offset and -row.x.record.offset >= row.ra.offset
            continue
        assert (row.x.smaller, row.x.larger) == (row.first, row.second)
        want = against(row.second, row.first, 1000)
        assert row.x.record.offset == want[2] and row.x.record["range"][:1] == want[1][:1] and row.x.record.char == want[0]


def test_options_and_failure_table():
    made = sizing.IndexConfig.from_options({"numWorkers": "8 threads", "memoryLimit": "50", "tailLength": "x"})
    assert (made.num_workers, made.memory_limit, made.tail_length, made.resolved_limit(10)) == (8, 50, None, 100)
    assert sizing.IndexConfig.from_options({"numWorkers": "0", "memoryLimit": None}).num_workers == 4
    assert symbols.failure_table("abacabab") == [0, 0, 1, 0, 1, 2, 3, 2] and symbols.failure_table("") == []


def test_symbols(spark):
    df = spark.createDataFrame([(symbols.SEPARATOR,), (symbols.TERMINATOR,), ("x",), (None,)], "s string")
    got = [tuple(r) for r in df.select(symbols.is_separator(df.s), symbols.is_terminator(df.s), symbols.visible(df.s)).collect()]
    assert got == [(True, False, "#"), (False, True, "$"), (False, False, "x"), (False, False, "")]


def test_text_files(spark, tmp_path):
    for name, text in (("b.txt", "two\nlines\n"), ("a.txt", "one")):
        (tmp_path / name).write_text(text)
    assert [(r.doc_id, r.name, r.text) for r in corpora.read_texts(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, "a.txt", "one"), (1, "b.txt", "two\nlines\n")]
