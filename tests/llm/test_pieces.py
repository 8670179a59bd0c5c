from __future__ import annotations

import os
import random
import time

import pyarrow as pa
import pytest
from lexigrove.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")

ODD = ["", " ", "  ", "a", "▁", " ▁ a▁▁b", "  a   b    c ", "\n\n x\n", "\t\ty", "日本語 テスト 😀😀", "a" * 300, "ab" * 200 + " " * 40 + "x", "x\r\ny", "éàü ß", "The  quick   brown    fox", "a b", "http://www.example.com/a?b=c&d=1234567890"]


def texts(seed=3):
    r = random.Random(seed)
    out = list(ODD)
    out += ["".join(r.choice("abcde thein gor.,▁ \n") for _ in range(r.randrange(1, 60))) for _ in range(500)]
    out += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 1000), r.randrange(0x2500, 0x2600), 32])) for _ in range(r.randrange(1, 60))) for _ in range(300)]
    return out


def rows_of(flat, count):
    out, at = [], 0
    for n in count:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_bpe_equals_the_library():
    whole = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    t = texts()
    for part in (t[:300], t[300:], t):  # the second time, words are remembered
        assert rows_of(*pieces.encode_batch(pa.array(part), pieces.MODEL)) == whole.encode(part)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_equals_the_library(tmp_path, fallback):
    from sentencepiece import sentencepiece_model_pb2 as pb

    r = random.Random(9)
    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = fallback
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = True
    names = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * fallback
    strings = sorted({("▁" if r.random() < 0.4 else "") + "".join(r.choice("abcd") for _ in range(r.randrange(1, 5))) for _ in range(150)} | set("▁abc"))
    names += [(s, -r.random() * 9 - 1, 1) for s in strings]
    for piece, score, kind in names:
        p = model.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    t = ["".join(r.choice("aabbccd d  é") for _ in range(r.randrange(0, 40))) for _ in range(400)]
    assert rows_of(*pieces.encode_batch(pa.array(t), path)) == whole.encode(t)


def test_memory_may_be_emptied_at_any_time(monkeypatch):
    t = texts(5)[:200]
    want = rows_of(*pieces.encode_batch(pa.array(t), pieces.MODEL))
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    for i in range(0, 200, 20):
        assert rows_of(*pieces.encode_batch(pa.array(t[i : i + 20]), pieces.MODEL)) == want[i : i + 20]


def test_round_trip_and_edge_cases(spark):
    t = [x for x in texts() if "▁" not in x]
    rows = [(i, x, [1], "n") for i, x in enumerate(t)] + [(None, "null id", [1], "n"), (3, None, None, None), (3, t[3], None, None), (900, "word " * 100_000, None, None), (901, "x" * 50_000, None, None), (902, "a▁b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n_tokens string").repartition(3)
    out = pieces.encode(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.ids is None:
            assert r.n_tokens is None and r.round_trip is None
        else:
            assert r.n_tokens == len(r.ids) and r.round_trip == (r.doc_id != 902)
    assert sum(r.ids is None for r in out) == 1
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(pieces.encode(docs)).collect()), key=str)
    assert back == sorted(((i, x and x.replace("▁", " ")) for i, x, *_ in rows), key=str)
    assert pieces.encode(docs.limit(0)).count() == 0


def test_runs_of_marks_of_any_length():
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.PieceModel(pieces.MODEL)
    for n in (2, 3, 16, 17, 33, 500, 4097):
        for text in ("a" + " " * n + "b", " " * n, "a" + " " * n + "the" + " " * n):
            assert pieces.encode_batch(pa.array([text]), pieces.MODEL)[0].tolist() == library.encode(text)
    began = time.time()
    assert "".join(model.merges("a" + pieces.MARK * 100_000 + "b")[0]) == "a" + pieces.MARK * 100_000 + "b"
    assert time.time() - began < 10
