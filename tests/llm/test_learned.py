import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import cotrain, maxent, toxicity
from rasterloom.llm.tokens import numbered, runs, slices

SF = "/root/testdata/sf0.001"


def third(k):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == k


def test_language_model_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (-1, ""), (-1, ""), (-2, "huge " * 30_000)], "doc_id long, text string"))
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    got = maxent.score(docs, train).collect()
    rows = docs.collect()
    tok = lambda t: [*(t or "").encode().lower().split(), b" "]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r.doc_id) for w in tok(r.text))
    n, v = sum(counts.values()), len(counts)
    want = {r.doc_id: tok(r.text) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0
    twins = [r.score for r in got if r.doc_id == -1]
    assert len(twins) == 2 and twins[0] == twins[1]
    # The score of each text, token by token, from the weights of a second fit.
    learned = docs.where(train)
    fold = F.xxhash64(F.lit("fold"), F.col("doc_id"))
    voc, weights, n_all, v_all = maxent.fit(learned, maxent.count_tokens(learned, "text"), fold)
    assert (n_all, v_all) == (n, v) and n == voc.total
    place = {int(h): (int(k), int(p), int(c)) for h, k, p, c in zip(voc.h, voc.k, voc.place, voc.c)}
    memo, last = maxent.Hashes(), voc.classes - 1
    in_class = Counter()
    for k, _, c in place.values():
        in_class[k] += c

    def softmax(z, i):
        return z[i] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))

    for r in [r for r in got if 1 < r.n_tokens < 60][:12]:
        ws, total = want[r.doc_id], 0.0
        hs = np.array([memo[w] for w in ws], np.uint64)
        ks = np.array([place.get(int(h), (last, -1, 0))[0] for h in hs])
        outer, inner = weights.features(hs, ks, np.array([0, len(hs)]))
        for i, w in enumerate(ws):
            k, p, c = place.get(int(hs[i]), (last, -1, 0))
            total += softmax([float(voc.prior[j] + sum(weights.outer[x, j] for x in outer[:, i])) for j in range(voc.classes)], k)
            if p >= 0:
                size = int((voc.bias[k] > -1e8).sum())
                total += softmax([float(voc.bias[k, j] + sum(weights.inner[x, j] for x in inner[:, i])) for j in range(size)], p)
            elif k != last:
                total += math.log(c / in_class[k])
            else:
                total += math.log((counts[w] + 1) / (voc.rare_n + voc.rare_v + 1))
        assert math.isclose(r.score, total / math.log(10), rel_tol=2e-3), r.doc_id
    assert sum(r.score - r.base_score for r in got if r.held_out and r.doc_id != -2) > 0
    assert maxent.score(docs.limit(0), train).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in maxent.score(docs.limit(5), F.lit(False)).collect())


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(1, 1 << 62, 9000).astype(np.uint64))
    c = np.sort(rng.integers(2, 3000, 9000))[::-1]
    voc = maxent.Vocabulary(h, c, 50, 20)
    voc.arrange(rng.integers(0, 50, (maxent.FRONT, 2 * maxent.NEIGHBOURS)).astype(float))
    w = maxent.Weights(voc.classes, voc.inner_classes)
    w.outer[:] = rng.normal(size=w.outer.shape)
    w.inner[:] = rng.normal(size=w.inner.shape)
    for context in ([], [int(h[5])], [int(h[5]), 12345]):
        texts = [np.array([*context, x], np.uint64) for x in [*h.tolist(), 77]]
        begin = np.cumsum([0, *map(len, texts)])
        logs, _ = maxent.log_probability(voc, w, np.concatenate(texts), begin)
        p = 10 ** logs[begin[1:] - 1]
        assert math.isclose(p[:-1].sum() + p[-1] * (50 + 20 + 1), 1, rel_tol=1e-4)


def test_toxicity_models_are_distributions_and_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 30}" for k in range(40)) + (" vile vile" if i % 3 == 0 else "")) for i in range(90)], "doc_id long, text string")
    fitted = docs.select(F.col("doc_id").alias("_tx_id"), (F.col("doc_id") % 3 == 0).cast("int").alias("_tx_y"))
    m = toxicity.fit(docs, "text", fitted, "doc_id")
    memo, n, follows = toxicity.Hashes(), (Counter(), Counter()), {}
    for r in docs.collect():
        w, h, _ = toxicity.coded([r.text.encode()], memo)
        for x in set(zip(h.tolist(), w.tolist())):
            n[r.doc_id % 3 == 0][x] += 1
            follows.setdefault(x[1], set()).add(x[0])
    codes = np.arange(toxicity.BUCKETS)
    contexts = sorted({h for c in n for h, _ in c})
    smooth = toxicity.UNSEEN
    shared = lambda w: (len(follows.get(w, ())) + smooth) / (sum(map(len, follows.values())) + smooth * toxicity.BUCKETS)
    for c in (0, 1):
        ones, twos = (sum(v == k for v in n[c].values()) for k in (1, 2))
        d = ones / max(1, ones + 2 * twos)
        assert 0 <= d < 1
        word, total, at = Counter(), sum(n[c].values()), Counter()
        for (h, w), k in n[c].items():
            word[w] += k
            at[h] += k
        other = Counter()
        for (h, w), k in n[1 - c].items():
            other[w] += k
        of_h = lambda k, h: sum(v for (x, _), v in n[k].items() if x == h)
        own = {w: max(word[w] - d, 0) / total for w in follows if word[w] + other[w] >= toxicity.SUPPORT}
        for h in [*contexts[:6], 12345]:
            assert math.isclose(m.probability(c, codes, np.full(len(codes), h)).sum(dtype=np.float64), 1, rel_tol=1e-4)
            known = min(of_h(0, h), of_h(1, h)) >= toxicity.SUPPORT
            kept = {w: max(n[c][h, w] - d, 0) / at[h] for w in follows if known and n[0][h, w] + n[1][h, w] >= toxicity.SUPPORT}
            for w in sorted(follows)[:20]:
                want = kept.get(w, 0) + (1 - sum(kept.values())) * (own.get(w, 0) + (1 - sum(own.values())) * shared(w))
                assert math.isclose(m.probability(c, np.array([w]), np.array([h]))[0], want, rel_tol=1e-4), (c, h, w)


def test_toxicity_finds_planted_words(spark):
    text = lambda i, bad: " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(60)) + (" you vile rat" if bad else " my dear cat")
    docs = spark.createDataFrame([(i, text(i, i % 4 == 0), 1) for i in range(600)] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = {r.doc_id: r["_toxicity"] for r in toxicity.score(docs, labels, third(0), third(2)).collect()}
    twice = docs.unionByName(docs.where("doc_id < 40")).unionByName(spark.createDataFrame([(902, text(1, False) * 2000, 1)], docs.schema))
    both = [(r.doc_id, r["_toxicity"]) for r in toxicity.score(twice, labels, third(0), third(2)).collect()]
    assert len(both) == 643 and len(set(both)) == 603 and dict(both)[902] < 0.7
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] < 0.7
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in range(600)]) > 0.99
    assert {r.toxicity for r in toxicity.score(docs.drop("toxicity"), labels.limit(0), third(0), third(2)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels, third(0), third(2)).count() == 0


def test_cotraining_learns_from_unlabelled(spark):
    """Labelled rows use other words than most unlabelled ones; only the sources tell those words' classes, and the rows
    that are judged have no source."""
    old, new = ("fine", "foul"), ("neat", "drab")
    text = lambda i, pair, good: " ".join(f"{pair[0 if good else 1]}{(i * 3 + k) % 20}" for k in range(30))
    rows = [(i, text(i, old, i % 2 == 0), "en", f"s{i % 2}", 100) for i in range(400)]
    rows += [(i, text(i, new, i % 2 == 0), "en", f"s{i % 2}", 100) for i in range(1000, 1400)]
    judged = [(i, text(i, new, i % 2 == 0), None, None, None) for i in range(2000, 2100)]
    docs = spark.createDataFrame(rows + judged, "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)], "doc_id long, quality int")

    def right(rounds):
        got = cotrain.score(docs, labels, F.lit(True), rounds=rounds).where("doc_id >= 2000").collect()
        return np.mean([(r.quality_score >= 0.5) == (r.doc_id % 2 == 0) for r in got])

    assert right(2) > 0.95 and right(0) < 0.7


def test_cotraining_edges(spark):
    rows = [(i, f"good w{i % 9} fine" if i % 2 else f"BAD x{i % 7}!", "en", "s", 9, 1.5) for i in range(200)] + [(900, None, None, None, None, None), (901, "", "en", "x", 0, 0.0), (902, "good " * 200_000, "en", "s", 10**6, 0.0)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string, source string, n_chars int, quality_score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = [(r.doc_id, r["_quality_score"]) for r in cotrain.score(docs, labels, F.lit(True)).collect()]
    assert len(got) == 223 and len(set(got)) == 203 and all(0 <= s <= 1 for _, s in got) and dict(got)[902] > 0.5
    assert np.mean([(s >= 0.5) == (i % 2 == 1) for i, s in got if i < 200]) > 0.98
    assert {r["_quality_score"] for r in cotrain.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert cotrain.score(docs.limit(0), labels, F.lit(True)).count() == 0


def test_cotraining_views_agree_before_they_teach():
    views = cotrain.Views(*(np.ones((2, 2)),) * 3)
    views.good, views.sure = 0.5, np.array([[-2.0, 2.0], [-2.0, 2.0]])
    p = np.array([[0.99, 0.5], [0.99, 0.1], [0.01, 0.5], [0.01, 0.9], [0.5, 0.99], [0.5, 0.8]])
    content, meta = cotrain.exchanged(views, np.log(p / (1 - p)))
    surest = round(0.98**2 * 0.5 * 64) / 64
    assert meta.tolist() == [[0, surest], [0, 0], [surest, 0], [0, 0], [0, 0], [0, 0]] and content.tolist() == [[0, 0]] * 4 + [[0, surest], [0, 0]]
    views.good = 0.99  # as sure as the share of good rows: nothing to teach
    assert cotrain.exchanged(views, np.log(p / (1 - p)))[1][0].tolist() == [0, 0]


def test_cotraining_counts_of_content_change_by_exchange(spark, monkeypatch):
    """On the given tables: pseudo-labels of the metadata view reach the content view, and the other way."""
    seen, plain = [], cotrain._sums
    monkeypatch.setattr(cotrain, "_sums", lambda rows, run: seen.append(plain(rows, run)) or seen[-1])
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = cotrain.score(docs, labels, third(1) == False, rounds=1)  # noqa: E712
    assert got.count() == docs.count() and len(seen) == 2
    assert all(after.sum() > before.sum() for before, after in zip(*seen))


def test_language_model_learns_from_every_training_text(spark, monkeypatch):
    counted, plain = [], maxent._near
    monkeypatch.setattr(maxent, "_near", lambda docs, front: counted.append(docs.count()) or plain(docs, front))
    docs = spark.createDataFrame([(i, f"one{i} two{i} one{i} two{i}") for i in range(60)], "doc_id long, text string")
    voc, weights, n, _ = maxent.fit(docs, maxent.count_tokens(docs, "text"), F.xxhash64(F.lit("fold"), F.col("doc_id")))
    assert counted == [60] and n == 300
    memo = maxent.Hashes()
    for i in range(60):
        ids = np.array([memo[b"one%d" % i], memo[b"two%d" % i], memo[b" "]], np.uint64)
        outer, _ = weights.features(ids, voc.look(ids)[0], np.array([0, 3]))
        # The words of this text alone stand before its tokens.
        assert weights.outer_q[outer[0, 1]] > 1 and np.abs(weights.outer[outer[0, 1]]).max() > 0, i


def test_gradients_are_summed_by_row():
    rng = np.random.default_rng(3)
    r = np.concatenate([np.full(90, 7), rng.integers(0, 60, 200), [65000]]).astype(np.uint16)
    g = rng.normal(size=(len(r), 5)).astype(np.float32)
    here, total = maxent.totals(g, r)
    assert here.tolist() == sorted(set(r.tolist()))
    for x, t in zip(here, total):
        assert np.allclose(t, g[r == x].sum(axis=0), atol=1e-4)


def test_steps_in_place_equal_plain_gradients():
    """A step over more tokens than are made at once, with weights whose exponentials overflow, as by plain sums in 64 bits."""
    rng = np.random.default_rng(5)
    n = maxent.STEP * 2 + 7
    rows, chosen = rng.integers(0, 40, (2, n)).astype(np.uint16), rng.integers(0, 6, n)
    for scale in (1, 200):
        w = (rng.normal(size=(40, 6)) * scale).astype(np.float32)
        want, q, squares = w.astype(np.float64), np.ones(40, np.float32), np.ones(40)
        z = w.astype(np.float64)[rows].sum(axis=0)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = np.eye(6)[chosen] - p / p.sum(axis=1, keepdims=True)
        for r in rows:
            total = np.zeros((40, 6))
            np.add.at(total, r, g)
            squares += (total * total).sum(axis=1)
            want += maxent.RATE * total / np.sqrt(squares)[:, None]
        maxent._step(w, q, rows, np.zeros(6, np.float32), None, chosen)
        assert np.allclose(w, want, rtol=1e-4, atol=1e-3) and np.allclose(q, squares, rtol=1e-3)


def test_tokens_of_a_run_are_those_of_bytes():
    """All bytes beside words, null, blank and empty texts, and parts of a column: as lower-cased and split text by text."""
    texts = [b" One\ttwo\x0b\x0cTWO\x1cx ", None, b"", b" \r\n", bytes(range(256)), *(bytes([65, i, 90]) for i in range(256)), b"one " * 400, "Ä É".encode()]
    col = pa.array([b"before", *texts, b"after"], pa.binary()).slice(1, len(texts))
    for size in (1, 300, 1 << 20):
        got = []
        for first, part in runs(col, size):
            assert first == len(got)
            begin, at, h = numbered(part, maxent.END)
            assert len(set(h.tolist())) == len(h) == len(np.unique(at))
            begins, (ids, twice) = maxent.coded(part, lambda x: (x * np.uint64(2),))
            assert begins.tolist() == begin.tolist() and (ids == h[at]).all() and (twice == ids * np.uint64(2)).all()
            got += [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
        assert got == [[xxhash.xxh64_intdigest(w) for w in [*(t or b"").lower().split(), maxent.END]] for t in texts]
        assert [(first, part.to_pylist()) for first, part in runs(col, size)] == [(first, [texts[first + i] for i in range(len(part))]) for first, part in slices(col, size)]
    assert list(runs(col.slice(0, 0))) == []


def test_a_run_looks_up_each_word_once():
    """The different words of a run, in the order of their hashes, whatever their number of occurrences."""
    seen = []
    maxent.coded(pa.array(["a b a b a c", "b a A B", None] * 50), lambda h: seen.append(h.tolist()) or (h,))
    assert len(seen) == 1 and seen[0] == sorted(xxhash.xxh64_intdigest(w) for w in (b"a", b"b", b"c", maxent.END))


def test_sums_of_gradients_come_in_blocks():
    """No more sums than a block at once, those of most rows first, and the same bits as row by row."""
    rng = np.random.default_rng(8)
    r = np.concatenate([rng.integers(0, 900, 2000), np.full(maxent.MANY, 901)]).astype(np.uint16)
    g = rng.normal(size=(len(r), 7)).astype(np.float32)
    sizes, got = [], {}
    for here, total in maxent.summed(g, r):
        assert len(here) <= maxent.STEP
        sizes += np.bincount(r)[here].tolist()
        got |= {int(x): t.copy() for x, t in zip(here, total)}
    assert sizes == sorted(sizes, reverse=True) and set(got) == set(r.tolist())
    for x, total in got.items():
        want = np.zeros(7, np.float32)
        for row in g[r == x]:
            want = want + row
        assert (total == want).all()
