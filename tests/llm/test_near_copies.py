import random

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import near_copies as n
from rasterloom.llm import simhash as s


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def edited(rnd, words, every):
    return " ".join(f"e{rnd.getrandbits(40)}" if i % every == every // 2 else w for i, w in enumerate(words))


def rows():
    rnd, out = random.Random(5), []
    for _ in range(40):
        words = [f"w{rnd.getrandbits(40)}" for _ in range(400)]
        # One word in 60 is another: a similarity of about 0.84; one in 30: about 0.7.
        out += [" ".join(words), edited(rnd, words, 60), edited(rnd, [f"x{w}" for w in words], 60), edited(rnd, words, 30)]
    return [*out, "a b", "A  b", "a b c", "", " \n"]


def test_near_counts_exactly():
    texts = rows()[:12] + rows()[-5:]
    found = n.near([t.encode() for t in texts])
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert found[i, j] == (a.split() == b.split() or jaccard(a, b) >= 0.8)


def test_deduplicate_takes_near_copies_beyond_two_bits_and_no_others(spark):
    texts = rows()
    bits = lambda a, b: bin(s.fingerprint(a.encode()) ^ s.fingerprint(b.encode())).count("1")
    assert sum(bits(texts[4 * k], texts[4 * k + 1]) > 2 for k in range(40)) > 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in s.deduplicate(df).collect()}
    assert kept == set(range(165)) - {4 * k + 1 for k in range(40)} - {161, 164}


def test_blocks_do_not_change_classes(spark):
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    group = [edited(rnd, words, 100 + k) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(group)), "doc_id long, text string")
    for block in (1000, 7):
        got = n.classes(df, F.xxhash64("text"), block=block).collect()
        assert len(got) == 60 and {r.component_id for r in got} == {0}


def test_candidates_are_those_of_bit_sliced_simhash(spark):
    rnd, texts = random.Random(11), []
    for _ in range(30):
        words = [f"w{rnd.getrandbits(40)}" for _ in range(200)]
        texts += [" ".join(words), edited(rnd, words, 90)]
    bits = n.fingerprints([t.encode() for t in texts], n.Hashes())
    for t, got in zip(texts[:4], bits):
        h, _ = n.shingles([f"{t} {t}".encode()], n.Hashes())
        assert got.shape == (n.BITS,) and abs(int(got.sum()) - n.BITS // 2) < 60 and len(set(h.tolist())) < len(h)
    # Three groups of lanes of different sizes, against distances pair by pair.
    prints = np.packbits(bits[:, : n.WIDE], axis=1, bitorder="little")
    for radius_bits in (0, n.RADIUS, n.RADIUS + 1):
        other = bits[0].copy()
        other[:radius_bits] ^= 1
        pair = np.packbits(np.stack([bits[0], other])[:, : n.WIDE], axis=1, bitorder="little")
        assert bool(n.candidates([(np.array([1, 2]), pair)])) == (radius_bits <= n.RADIUS)
    names = np.arange(60)
    got = n.candidates([(names[:31], prints[:31]), (names[31:34], prints[31:34]), (names[34:], prints[34:])])
    apart = (bits[:, None, : n.WIDE] != bits[None, :, : n.WIDE]).sum(axis=2)
    assert sorted(got) == [(k + 1, k) for k in range(0, 60, 2) if apart[k, k + 1] <= n.RADIUS and k != 30]
    # As a table: the same links whatever the lanes of a block.
    rows_ = [(i, p.tobytes(), k.tolist()) for i, (p, k) in enumerate(zip(prints, n.bands(bits)))]
    df = spark.createDataFrame(rows_, "th long, print binary, bands array<int>")
    for lanes in (1000, 1):
        assert {(max(r), min(r)) for r in n.links(df, lanes).collect()} == {(k + 1, k) for k in range(0, 60, 2)}


def test_few_texts_move(spark):
    """Rows that stay and have no candidate are not dealt: copies, rows that are there several times and null ids still go right."""
    rnd = random.Random(11)
    texts = [" ".join("%016x" % rnd.getrandbits(64) for _ in range(1500)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[3]), (5, texts[5]), (5, texts[5]), (None, texts[6]), (None, "alone of its kind"), (101, texts[7] + " one more")]
    written = lambda: sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0)])
    before = written()
    got = s.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == {*enumerate(texts), (None, "alone of its kind")} and len(got) == 81
    assert written() - before < sum(map(len, texts)) / 2
