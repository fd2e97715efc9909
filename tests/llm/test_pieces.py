"""Merge rounds against the library itself."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillon.llm import pieces, queries

SF = "/root/testdata/sf0.001"
HARD = ["", None, " ", "  a  b ", "▁x ▁▁y", "a\tb\nc  d\n\n \n", "\xa0x ﬁ Ⅷ é", "<s> </s> <0x41> <unk>", "\0a", "　全角 日本語のテキスト", " " * 3000, "x" * 3000, "ab" * 900, "a" * 500, "abc" * 171, "é" * 40 + "😀" * 9, "wordwithout" * 100 + "\n" * 700]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_piece_model())


@pytest.fixture(scope="module")
def own():
    return pieces.piece_model(pieces.default_piece_model())


def check(library, own, texts):
    want = [library.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    got = own.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [own.decode(g) for g in got] == [library.decode(w) for w in want]


def test_hard_texts(library, own):
    check(library, own, HARD)


def test_random_texts(library, own):
    r = random.Random(1)
    some = ["a", "b", "e", "t", "h", "in", " ", "  ", "\n", "▁", "é", "日", "本", "😀", "\t", "0", "́", "."]
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    for _ in range(60):
        check(library, own, ["".join(r.choice(some) for _ in range(r.randint(0, 80))) for _ in range(20)])
        check(library, own, ["".join(r.choice(names) for _ in range(r.randint(0, 60))) for _ in range(20)])


def test_rounds_and_heap_agree(own):
    r = random.Random(2)
    for _ in range(200):
        word = "".join(r.choice(["ab", "a", "the", "s", "▁", "in"]) for _ in range(r.randint(1, 120)))
        symbols = own.points[np.frombuffer(word.encode("utf-32-le"), "<u4")]
        flat, ends = own.merge_rounds(symbols.copy(), np.array([len(symbols)]))
        assert flat.tolist() == own.merge_by_heap(symbols).tolist() and ends.tolist() == [len(flat)]


def test_stretches_and_small_caches(library, monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 7)
    check(library, pieces.PieceModel(pieces.default_piece_model(), most=5), [*HARD[:10], "several words  and   runs of spaces " * 20])


def test_any_ids_decode_as_the_library_does(library, own):
    r = random.Random(3)
    for _ in range(5000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.choice([0, 1, 2]), 259, 28705]) for _ in range(r.randint(0, 8))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_query_against_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = queries.op12_sentencepiece(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))


def test_rows_hard(spark, library):
    rows = [(None, "one text"), (1, "one text"), (1, "one text"), (2, None), (3, ""), (4, "x y " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("theirs"))
    path = pieces.default_piece_model()
    got = pieces.encode(df, path, decoded=True).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((r.doc_id, r.decoded) for r in got), key=key) == sorted(((k, t or "") for k, t in rows), key=key)
    back = pieces.decode(pieces.encode(df, path), path).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((r.doc_id, r.decoded) for r in got), key=key)
    assert pieces.encode(df.limit(0), path, decoded=True).count() == 0
