import hashlib
import random

import pytest

from rasterloom.operators import selection as S

SCHEMA = "split string, group_id string, country string, labels map<string,int>, size int"


def brute(rows, target, floor, seed):
    """All gains anew before each pick."""
    out = []
    for split in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == split]
        total = sum(r[4] for r in own)
        source, want, have = {}, {}, {}
        for _, _, land, labels, n in own:
            for k, v in [*((("l", x), c) for x, c in labels.items()), (("c", land), n)]:
                source[k] = source.get(k, 0) + v
        for k, v in source.items():
            want[k] = max(floor if k[0] == "l" else 1, (v * target + total // 2) // total)
        got, picks = 0, []
        while got < target:
            best = None
            for r in own:
                if r in picks:
                    continue
                gain = 0
                for k, v in [*((("l", x), c) for x, c in r[3].items()), (("c", r[2]), r[4])]:
                    lack = max(0, want[k] - have.get(k, 0))
                    gain += max(1, 10**9 // source[k]) * (lack**2 - max(0, lack - v) ** 2)
                rank = (-gain, hashlib.sha256(f"{seed}\0{split}\0{r[1]}".encode()).hexdigest(), r[1])
                if best is None or rank < best[0]:
                    best = (rank, r)
            picks.append(best[1])
            got += best[1][4]
            for k, v in [*((("l", x), c) for x, c in best[1][3].items()), (("c", best[1][2]), best[1][4])]:
                have[k] = have.get(k, 0) + v
            out.append((split, best[1][1], len(picks) - 1, -best[0][0], best[1][4]))
    return out


@pytest.mark.parametrize("most", [2, 5, 256])
def test_greedy_coverage_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(S, "ROUND", most)
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        labels = {x: rnd.randint(1, 6) for x in rnd.sample("abcde", rnd.randint(1, 4))}
        rows.append((f"s{i % 2}", f"g{i}", rnd.choice(["FI", "PT", "AT"]), labels, max(labels.values()) + rnd.randint(0, 3)))
    got = S.greedy_coverage(spark.createDataFrame(rows, SCHEMA), 60, 3, "seed").collect()
    assert sorted(tuple(r) for r in got) == sorted((s, g, k, gain, n) for s, g, k, gain, n in brute(rows, 60, 3, "seed"))


def test_greedy_coverage_refuses_what_cannot_be(spark):
    df = spark.createDataFrame([("s", "g", "FI", {"a": 2}, 5)], SCHEMA)
    for target, floor, expected in ((6, 0, ()), (5, 3, ()), (5, 1, ("b",))):
        with pytest.raises(ValueError):
            S.greedy_coverage(df, target, floor, "x", expected=expected)
    assert S.greedy_coverage(df, 5, 1, "x").count() == 1
