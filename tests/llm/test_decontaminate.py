import pickle
import random
import re

import numpy as np

from rasterloom.llm import decontaminate as d


def brute(docs, items):
    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    out = {}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, text in items:
            v = words(text)
            n = min(13, len(v))
            for at in range(len(v) - n + 1) if v else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[at : at + n]:
                        hit.update(range(s, s + n))
                        names.add(str(name))
        out[i] = (len(w), len(hit), sorted(names))
    return out


def check(spark, docs, items, **kw):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.c.n_words, r.c.n_hit, r.c["items"]) for r in d.annotate(a, b, out="c").collect()}
    assert got == brute(docs, items)


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    vocabulary = ["a", "B", "c9", "é", "dd"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(rnd.choice([1, 2, 4, 5, 6, 13, 14, 20]))) for k in range(12)] + [(90, ""), (91, None), (92, "--"), (10, "Zz yy"), (11, "Zz yy")]
    docs = [(k, " ".join([text(rnd.randint(0, 60)), rnd.choice(items)[1] or "", text(5)])) for k in range(40)] + [(100, None), (101, ""), (102, "zz, YY!"), (103, "zz")]
    check(spark, docs, items)
    # Several blocks give the same, and only one is alive at a time.
    monkeypatch.setattr(d, "BLOCK_BYTES", 200)
    monkeypatch.setattr(d.Block, "most", 0)
    check(spark, docs, items)
    assert d.Block.most == 1
    # So do pieces of a long item, and a join without a broadcast.
    monkeypatch.setattr(d, "BLOCK_BYTES", 1 << 20)
    monkeypatch.setattr(d, "PIECE", 15)
    monkeypatch.setattr(d, "SMALL", -1)
    check(spark, docs, items)


def test_memory_of_a_block():
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60_000)).encode()
    block = d.Block([("x", text)])
    assert block.windows == 60_000 - 12 and len(pickle.dumps(block)) < 14 * len(text)
    block.choose(np.ones(block.shingles, np.int64))
    assert len(pickle.dumps(block)) < 14 * len(text)


def test_edges(spark):
    check(spark, [(1, "a b")], [])
    empty = spark.createDataFrame([], "doc_id long, text string, contamination int")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.decontaminate(empty, items).count() == 0
    clash = spark.createDataFrame([(1, "x a b c y", 5), (1, "x a b c y", 5), (2, " ".join(["w"] * 100) + " a b c", 6)], empty.schema)
    kept = d.decontaminate(clash, items).collect()
    assert [(r.doc_id, r.contamination) for r in kept] == [(2, 6)]
