from __future__ import annotations

import os
import random

import numpy as np
import pytest
from lexigrove.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")

TEXTS = ["one line", "two\nlines\n", "\n\n\n", "a\n\n  b \n \n\tc", "é日😀\n\n日本\n", "", None, "x" * 20000 + "\n" + "y z " * 9000, "<|endoftext|>\n<|endoftext|>", " \n \n \n"]


def brute(text, rule):
    """Token by token and section by section."""
    coder, lengths = tokens.encoding(tokens.VOCABULARY)
    raw = text.encode()
    bounds, at = [0], 0
    for line in [x + b"\n" for x in raw.split(b"\n")[:-1]] + [raw.split(b"\n")[-1]]:
        at += len(line)
        if line:
            bounds.append(at)
    counts = [[0, 0] for _ in bounds[1:]]
    at = 0
    for token in coder.encode_ordinary(text):
        a, b = at, at + int(lengths[token])
        at = b
        over = [(sum((raw[i] & 0xC0) != 0x80 for i in range(max(a, x), min(b, y))), k) for k, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if max(a, x) < min(b, y)]
        if rule == "first":
            k = over[0][1]
        elif rule == "last":
            k = over[-1][1]
        else:
            k = max(over, key=lambda o: (o[0], -o[1]))[1]
        counts[k][0] += 1
        counts[k][1] += len(over) > 1
    assert at == len(raw)
    return [(k, len(raw[:x].decode()), len(raw[:y].decode()), *counts[k]) for k, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False))]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections_against_brute_force(spark, rule):
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("ab é\n\n .") for _ in range(r.randrange(1, 80))) for _ in range(60)]
    rows = [(i, t, 5, "s") for i, t in enumerate(texts)] + [(None, "no id\n", 5, "s"), (1, texts[1], 5, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, section int, lead string").repartition(3)
    got = sorted(map(tuple, tokens.section_tokens(docs, rule=rule).collect()), key=str)
    want = [(i, *x) for i, t, *_ in rows if t for x in brute(t, rule)]
    assert got == sorted(want, key=str)


def test_majority_takes_the_earlier_of_equals():
    where, crossing = tokens.attribute(np.array([0, 2]), np.array([2, 6]), np.array([0, 1, 5, 6]), "majority")
    assert where.tolist() == [0, 1] and crossing.tolist() == [True, True]


def test_bad_rule_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.section_tokens(docs).count() == 0
    with pytest.raises(ValueError):
        tokens.section_tokens(docs, rule="none")


@pytest.mark.parametrize("text", [" " * 5000, "a" + " " * 5000 + "b", "a\n" + "\n \t" * 3000 + "\nb 's", "x" + "  " * 4000 + "!", " " * 4096 + "  9", ("ab" + " " * 6000) * 3, "\n" * 5000])
def test_long_white_space_is_split_as_the_pattern_does(text):
    coder, _ = tokens.encoding(tokens.VOCABULARY)
    assert tokens.encode_text(coder, text).tolist() == coder.encode(text)


def test_white_space_of_any_length(spark):
    rows = [(1, " " * 1_000_000), (2, "\n" * 300_000), (3, "a" + "\t " * 500_000 + "b")]
    out = tokens.section_tokens(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, out)) == [(1, 1), (2, 300_000), (3, 1)]
