import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import hard_negatives as H

KIND = "id long, label long, vector array<double>, block string, rank int"


def brute(rows, anchor, positives=5, negatives=10):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a in rows:
        if a[0] is None or not anchor(a[0]):
            continue
        met = [(sum(int(x) * int(y) for x, y in zip(a[2], b[2])), b[0], b[1]) for b in rows if b[0] != a[0]]
        for s, p, _ in sorted((m for m in met if m[2] == a[1]), key=order)[:positives]:
            fit = sorted((m for m in met if m[2] != a[1] and 30 * s <= 100 * m[0] <= 90 * s), key=order)[:negatives]
            out += [(a[0], p, k + 1, m[1], s, m[0]) for k, m in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], KIND)
    return sorted(map(tuple, H.mine(df.withColumn("vector", H.whole(F.col("vector"), 1)), F.col("id") % 10 == 0).collect()), key=repr)


def test_equals_brute_force_with_ties_and_unequal_norms(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET", 16)
    monkeypatch.setattr(H, "ANCHORS", 5)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-3, 6, 4) * 4 ** int(rng.integers(0, 5))]) for i in range(400)]
    rows += [(400 + i, 1, rows[20][2]) for i in range(40)]  # one vector many times
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    v = [2.0, 1.0]
    rows = [(0, 1, v), (0, 1, v), (1, 1, v), (2, 2, [1.0, 1.0]), (2, 2, [1.0, 1.0]), (3, None, v), (4, 1, None), (5, 1, [1.0, None]), (6, 2, [math.nan, 1.0]), (7, 2, [math.inf, 1.0]), (None, 2, [1.0, 0.0]), (10, 1, [1.0]), (20, 9, []), (30, 5, [0.0, 0.0]), (31, 5, [1.0, 1.0])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []


def test_scores_beyond_doubles_are_exact(spark):
    big = float(1 << 28)
    rows = [(0, 1, [big + 1, 1.0]), (1, 1, [big + 1, 3.0]), (2, 2, [big / 2 + 1, 1.0]), (3, 2, [big / 2 + 1, 2.0])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, 1, [1e18]), (1, 1, [1e18])])


def test_later_buckets_are_passed_over():
    import pyarrow as pa

    one = pa.table({"key": pa.array([0], pa.int64()), "id": pa.array([-1], pa.int64()), "label": pa.array([0], pa.int64()), "vector": pa.array([[3.0]]), "low": pa.array([[-(1 << 63)]]), "high": pa.array([[1 << 62]])})
    block, n = H._Block(one, 2, False), 4 * H.BUCKET
    norms = np.linspace(9, 1, n)
    block.meet(norms, np.arange(n), np.ones(n, np.int64), norms[:, None].round())
    assert block.done and block.firsts.id.tolist() == [[0, 1]]
