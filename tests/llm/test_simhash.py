import random

import numpy as np
import xxhash

from rasterloom.llm import simhash as s
from rasterloom.llm.components import components


def slow_print(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_roots(prints):
    root = {p: p for p in prints}
    changed = True
    near = [(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    while changed:
        changed = False
        for a, b in near:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


def test_fingerprints():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50, 400):
        t = " ".join(rnd.choice(["Aa", "b", "É", "c\td"]) for _ in range(n))
        assert s.fingerprint(t.encode()) == slow_print(t)
    assert s.fingerprint(None) == 0
    assert s.fingerprint(b"x y z " * 70_000) == s.fingerprint(b"x y z " * 70_000)


def test_links_keep_components_whatever_the_block(spark):
    rnd = random.Random(1)
    prints = {0, 1, 3, 7}
    for _ in range(8):
        c = rnd.getrandbits(64)
        for _ in range(30):
            x = c
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    signed = [int(x) for x in np.array(sorted(prints), np.uint64).view(np.int64)]
    want = slow_roots(signed)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (1000, 8):
        got = {r.node: r.root for r in components(s.links(df, block)).collect()}
        assert all(got.get(x, x) == want[x] for x in signed)


def test_classes_and_duplicates(spark):
    words = [f"w{i}" for i in range(300)]
    a = " ".join(words)
    rows = [(5, a), (3, a + " end"), (7, "other text entirely different from that"), (8, None), (9, ""), (None, a), (7, "other text entirely different from that"), (11, "one two")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component_id int")
    got = s.classes(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    prints = {r.doc_id: r.fp for r in got}
    if bin((prints[5] ^ prints[3]) & (1 << 64) - 1).count("1") <= 2:
        assert by[5] == by[3] == by[None] == 3
    assert by[8] == by[9] == 8 and by[7] == 7
    kept = s.deduplicate(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(by.values())) and set(kept[0].asDict()) == {"doc_id", "text", "fp", "component_id"}
    assert s.deduplicate(df.limit(0)).count() == 0
