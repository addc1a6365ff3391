import random

import numpy as np
import pytest

from rasterloom.llm import substrings as S
from rasterloom.llm.fm_index import Index, WaveletTree


def brute(rows):
    """(id, words, removed, kept) of each row, by all windows."""
    least: dict = {}
    split = [(i, (t or "").replace("\x0b", " ").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if i is not None and (g not in least or i < least[g]):
                least[g] = i
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - 49) if i is not None and least[tuple(w[k : k + 50])] < i for j in range(50)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("ä b c dd e fff g hh i jj k l m n o p q r s t".split()) + str(rng.randrange(30))
    prose = lambda n: [word() for _ in range(n)]
    shared, rows = [prose(n) for n in (49, 50, 51, 80, 130)], []
    for i in range(60):
        w = prose(rng.randrange(0, 120))
        for p in rng.sample(shared, 2):
            at = rng.randrange(len(w) + 1)
            w = w[:at] + p + w[at:]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100 + k, rows[3][1]) for k in range(5)] + [(2, rows[9][1]), (200, "x " * 400), (201, "y x " + "x " * 300)]
    rows += [(None, rows[4][1]), (300, None), (301, ""), (302, " \x0b"), (303, "short"), rows[7], rows[7], (-5, "　".join(prose(60)))]
    rows.append((400, " ".join(prose(30_000) + shared[4] + prose(3))))
    return rows


@pytest.mark.parametrize("hot, shard", [(2048, 2048), (3, 4)])
def test_equals_all_windows(spark, hot, shard):
    """Also with keys that must be split down to single windows, and many shards."""
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k", [1]) for i, t in rows], "doc_id long, text string, runs string, _t1 array<int>").repartition(5)
    found = S.deduplicate(docs, hot=hot, shard=shard)
    assert found.columns == [*docs.columns, "repeats"]
    got = sorted(((r.doc_id, r.repeats.n_words, r.repeats.n_removed, r.repeats.kept) for r in found.collect()), key=repr)
    assert got == brute(rows) and sum(r[2] for r in got) > 5000


def test_empty_table(spark):
    assert S.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("depth", [3, 5, 50])
def test_index_finds_what_is_there(depth):
    """Patterns that are not in the index too, and symbols it lacks."""
    rng = np.random.default_rng(depth)
    held = [rng.integers(0, 3, rng.integers(0, 120)) for _ in range(30)] + [np.zeros(70, np.int64)] * 2
    asked = held[:10] + [np.concatenate([h[5:], rng.integers(-1, 3, 9), h[:60]]) for h in held]
    begin = lambda xs: np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    index = Index(np.concatenate(held), begin(held), depth)
    got = {(int(p), int(a)): sorted(index.owner[index.order[lo:hi]].tolist()) for p, a, lo, hi in zip(*index.matches(np.concatenate(asked), begin(asked)))}
    want = {}
    for i, p in enumerate(asked):
        for a in range(len(p) - depth + 1):
            if found := [j for j, q in enumerate(held) for b in range(len(q) - depth + 1) if (q[b : b + depth] == p[a : a + depth]).all()]:
                want[i, a] = found
    assert got == want and want


def test_wavelet_tree_counts():
    rng = np.random.default_rng(1)
    x, at = rng.integers(0, 37, 500), rng.integers(0, 501, 300)
    asked = x[rng.integers(0, 500, 300)]
    assert (WaveletTree(x, 37).rank(asked, at) == [(x[:a] == c).sum() for c, a in zip(asked, at)]).all()
