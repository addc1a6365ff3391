import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from rasterloom.llm import byte_bpe as b

RANKS = b.read_ranks(P.path("byte_bpe_50k.tiktoken"))
WHOLE = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(x): int(y) for x, y in map(bytes.split, RANKS.splitlines())}, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(40, 16), (20, 3), (64, 30), (10_000, 100)])
def test_chunks_equal_whole_texts(spark, chunk, overlap):
    rnd = random.Random(chunk)
    atoms = ["a", "b", " ", "  ", "\n", "\n\n", " \n", "'s", "'ll", "9", "12", "é", "ñu", "!", "?!", "\t", "　", "\x1c", "\x85", "字", "😀", "'", "the ", " of", "<|endoftext|>"]
    texts = ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 300))) for _ in range(120)]
    texts += [None, "", " " * 200, "\n" * 99 + "x", "a" * 333, "a" * 150 + " " * 120 + "b " * 40]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    coded = b.encode(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap)
    got = {r.doc_id: r for r in b.decode(coded, RANKS, ids="_ids").collect()}
    for i, t in enumerate(texts):
        assert got[i]["_ids"] == WHOLE.encode_ordinary(t or "") and bytes(got[i]["bytes"]) == (t or "").encode() and got[i]["ids"] == 1


def test_texts_can_be_left_out(spark):
    df = spark.createDataFrame([(1, "a b " * 30), (2, "a"), (3, None)], "doc_id long, text string")
    got = b.encode(df, RANKS, P.PATTERN, chunk=40, overlap=16, keep=False)
    assert got.columns == ["doc_id", "ids"] and {r.doc_id: r.ids for r in got.collect()} == {1: WHOLE.encode_ordinary("a b " * 30), 2: WHOLE.encode_ordinary("a"), 3: []}
    assert b.encode(df.select("text"), RANKS, P.PATTERN).count() == 3 and b.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_long_stretch_is_split_by_the_pattern(monkeypatch):
    monkeypatch.setattr(b, "LONG", 10)
    for t in ("a b  c\n\n d's 12x" * 9, " " * 50, "x" * 99):
        assert b.encode_stretch(t, RANKS, P.PATTERN) == WHOLE.encode_ordinary(t)


def test_repeated_rows_and_clashing_columns(spark):
    """Rows repeated under one id each get their ids, long ones too, and columns of the operator's own names pass through."""
    long = "word's 12 é\n" * 40
    df = spark.createDataFrame([(1, long, 5, 6), (1, long, 5, 6), (1, "a b", 5, 6), (None, None, None, None)], "doc_id long, text string, _bpe_row long, no int")
    got = b.encode(df, RANKS, P.PATTERN, chunk=64, overlap=16).collect()
    assert sorted(map(len, (r.ids for r in got))) == sorted(len(WHOLE.encode_ordinary(t)) for t in (long, long, "a b", ""))
    assert all(r.ids == WHOLE.encode_ordinary(r.text or "") for r in got) and [(r["_bpe_row"], r.no) for r in got if r.doc_id] == [(5, 6)] * 3


def test_ids_are_decoded_where_they_are_made(spark):
    """The same rows as by ``decode``, without a second Python worker beside that of the short texts."""
    long = "word's 12 é\n" * 40
    df = spark.createDataFrame([(1, long, 5), (2, "a b", 5), (3, "", 5), (None, None, None)], "doc_id long, text string, bytes int")
    coded = b.encode(df, RANKS, P.PATTERN, chunk=64, overlap=16, keep=False)
    met = b.encode(df, RANKS, P.PATTERN, chunk=64, overlap=16, keep=False, decoded="bytes")
    want = b.decode(coded, RANKS)
    assert met.dtypes == want.dtypes and sorted(met.collect(), key=str) == sorted(want.collect(), key=str)
    assert {r.doc_id: bytes(r["_bytes"]) for r in met.collect()} == {1: long.encode(), 2: b"a b", 3: b"", None: b""}
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInArrow" not in plan[: plan.index("Union")]
