"""Projections, warps, percentiles, running sums, pyramids and model inputs against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import projections as J
from rasterloom.operators import pairs as P
from rasterloom.operators import pyramid as Y
from rasterloom.operators import ranks as K
from rasterloom.operators import warp as V

NAN = float("nan")


def lonlat(x, y, zone, south):
    """UTM to degrees by the classical power series, good to some millimetres: an independent way."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    m = (y - (1e7 if south else 0)) / k0
    mu = m / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * math.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * math.sin(4 * mu) + 151 * e1**3 / 96 * math.sin(6 * mu) + 1097 * e1**4 / 512 * math.sin(8 * mu)
    c, t = ep * math.cos(p) ** 2, math.tan(p) ** 2
    n, r = a / math.sqrt(1 - e2 * math.sin(p) ** 2), a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    d = (x - 500000) / (n * k0)
    lat = p - n * math.tan(p) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep + 24 * t**2) * d**5 / 120) / math.cos(p)
    return zone * 6 - 183 + math.degrees(lon), math.degrees(lat)


def test_projections(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(350_000, 650_000), rng.uniform(100_000, 6_500_000) + 3_000_000 * (i % 2), 32601 + rng.randrange(60) + 100 * (i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, x double, y double, crs int").withColumn("d", J.to_degrees(F.col("x"), F.col("y"), F.col("crs")))
    df = df.withColumn("b", J.from_degrees(F.col("d.x"), F.col("d.y"), F.col("crs"))).withColumn("m", J.convert(F.col("x"), F.col("y"), F.col("crs"), F.lit(3857))).withColumn("w", J.convert(F.col("m.x"), F.col("m.y"), F.lit(3857), F.col("crs")))
    for r in df.collect():
        lon, lat = lonlat(r.x, r.y, r.crs % 100, r.crs > 32700)
        assert abs((r.d.x - lon + 180) % 360 - 180) < 1e-6 and abs(r.d.y - lat) < 1e-6
        assert abs(r.b.x - r.x) < 1e-6 and abs(r.b.y - r.y) < 1e-6 and abs(r.w.x - r.x) < 1e-6 and abs(r.w.y - r.y) < 1e-6
    one = spark.range(1).select(J.from_degrees(F.lit(6.0), F.lit(0.0), F.lit(32631)).alias("a"), J.from_degrees(F.lit(0.0), F.lit(90.0), F.lit(3857)).alias("p"), J.from_degrees(F.lit(0.0), F.lit(91.0), F.lit(4326)).alias("q"), J.to_degrees(F.lit(NAN), F.lit(0.0), F.lit(3857)).alias("n"), J.code(F.lit(" epsg:32733")).alias("c"), J.code(F.lit("EPSG:2154")).alias("u")).first()
    assert abs(one.a.x - 833978.557) < 1e-3 and abs(one.a.y) < 1e-6 and (one.p, one.q, one.n, one.c, one.u) == (None, None, None, 32733, None)


def test_bounds(spark):
    rows = [(0, 400000.0, 5e6, 500000.0, 5.1e6, 32633, 4326), (1, 166000.0, 0.0, 300000.0, 1e5, 32601, 4326), (2, 400000.0, 9.9e6, 600000.0, 9.999e6, 32633, 4326), (3, 400000.0, 1000.0, 600000.0, 50000.0, 32733, 4326), (4, 10.0, 40.0, 12.0, 45.0, 4326, 3857), (5, 10.0, 40.0, 12.0, 45.0, 4326, 32632), (6, 0.0, 80.0, 1.0, 90.0, 4326, 3857), (7, 5.0, 1.0, 4.0, 2.0, 4326, 3857), (8, 1.0, 1.0, 2.0, 2.0, 4326, 9999), (9, -1.0, -1.0, 1.0, 1.0, 4326, 4326)]
    df = spark.createDataFrame(rows, "i int, x1 double, y1 double, x2 double, y2 double, s int, t int")
    got = {r.i: r.b for r in df.select("i", J.transform_bounds(F.struct("x1", "y1", "x2", "y2"), F.col("s"), F.col("t")).alias("b")).collect()}
    ring = [(400000 + 1e5 * k / 200, 5e6 + 1e5 * side) for k in range(201) for side in (0, 1)] + [(400000 + 1e5 * side, 5e6 + 1e5 * k / 200) for k in range(201) for side in (0, 1)]
    ds = [lonlat(x, y, 33, False) for x, y in ring]
    for v, w in zip(got[0], (min(d[0] for d in ds), min(d[1] for d in ds), max(d[0] for d in ds), max(d[1] for d in ds))):
        assert abs(v - w) < 1e-4
    assert got[1].x1 > 179 and -180 < got[1].x2 < -178  # over the antimeridian
    assert (got[2].x1, got[2].x2, got[2].y2) == (-180.0, 180.0, 90.0) and got[2].y1 < 90
    assert (got[3].x1, got[3].x2, got[3].y1) == (-180.0, 180.0, -90.0) or got[3].y1 > -90
    assert abs(got[4].x1 - 1113194.9079327357) < 1e-6 and got[5].x2 > 700000 and tuple(got[9]) == (-1.0, -1.0, 1.0, 1.0)
    assert got[6] is None and got[7] is None and got[8] is None


def tiles(grid, side, **keys):
    out = []
    for r in range(0, grid.shape[0], side):
        for c in range(0, grid.shape[1], side):
            part = grid[r : r + side, c : c + side]
            out.append((*keys.values(), r // side, c // side, *part.shape, [None if math.isnan(v) else float(v) for v in part.ravel()]))
    return out


def whole(rows, height, width, side, value=lambda r: r.data):
    out = np.full((height, width), NAN)
    for r in rows:
        part = np.array([NAN if v is None else v for v in value(r)], float).reshape(r.height, r.width)
        out[r.tile_row * side : r.tile_row * side + r.height, r.tile_col * side : r.tile_col * side + r.width] = part
    return out


def affine(t, x, y):
    return t[0] * x + t[1] * y + t[2], t[3] * x + t[4] * y + t[5]


def inverse(t, x, y):
    det = t[0] * t[4] - t[1] * t[3]
    return (t[4] * (x - t[2]) - t[1] * (y - t[5])) / det, (t[0] * (y - t[5]) - t[3] * (x - t[2])) / det


def warped(grid, source, target, h, w, method, through=lambda x, y: (x, y)):
    """Cell by cell over the whole raster."""
    H, W = grid.shape
    out = np.full((h, w), NAN)
    for y in range(h):
        for x in range(w):
            c, r = inverse(source, *through(*affine(target, x + 0.5, y + 0.5)))
            r, c = r - 0.5, c - 0.5
            if not (-0.5 <= r <= H - 0.5 and -0.5 <= c <= W - 0.5):
                continue
            if method == "nearest":
                out[y, x] = grid[min(math.floor(r + 0.5), H - 1), min(math.floor(c + 0.5), W - 1)]
                continue
            total = weight = 0.0
            for i in (0, 1):
                for j in (0, 1):
                    a, b = math.floor(r) + i, math.floor(c) + j
                    k = (1 - abs(r - a)) * (1 - abs(c - b))
                    if 0 <= a < H and 0 <= b < W and k > 0 and not math.isnan(grid[a, b]):
                        total, weight = total + k * grid[a, b], weight + k
            if weight > 0:
                out[y, x] = total / weight
    return out


GRID = "struct<a:double,b:double,c:double,d:double,e:double,f:double,width:int,height:int,crs:int>"
TILE = "observation string, band int, tile_row int, tile_col int, height int, width int, data array<double>"


@pytest.mark.parametrize("method", V.METHODS)
def test_warp_equals_the_whole_raster(spark, method):
    rng = np.random.default_rng(2)
    grids = [np.where(rng.random((23, 17)) < 0.2, NAN, rng.normal(size=(23, 17))) for _ in range(2)]
    source = (10.0, 1.0, 500000.0, 2.0, -9.0, 5000000.0)
    cases = {"same": (source, 23, 17), "finer": ((3.0, 0.0, 499990.0, 0.0, -4.0, 5000010.0), 40, 45), "coarser": ((31.0, 5.0, 500010.0, -4.0, -27.0, 4999990.0), 7, 6), "away": ((1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 5, 3), "flat": ((1.0, 1.0, 0.0, 1.0, 1.0, 0.0), 5, 3)}
    t = spark.createDataFrame([x for b, g in enumerate(grids) for x in tiles(g, 8, observation="o", band=b)], TILE)
    pairs = spark.createDataFrame([(k, "o", (*source, 17, 23, 32633), (*g, w, h, 32633)) for k, (g, h, w) in cases.items()], f"pair string, observation string, source {GRID}, target {GRID}")
    got = V.warp(t, pairs, 8, method, out_side=5).collect()
    assert not [r for r in got if r.pair == "flat"]
    for k, (g, h, w) in cases.items():
        want = [warped(x, source, g, h, w, method) for x in grids]
        for b in (0, 1) if k != "flat" else ():
            mine = [r for r in got if r.pair == k and r.band == b]
            np.testing.assert_allclose(whole(mine, h, w, 5), want[b], atol=1e-9)
            np.testing.assert_array_equal(whole(mine, h, w, 5, lambda r: r.valid) == 1, ~np.isnan(want[0]) & ~np.isnan(want[1]))


def test_warp_between_systems(spark):
    rng = np.random.default_rng(3)
    grid = rng.normal(size=(20, 20))
    source, target = (0.001, 0.0, 14.99, 0.0, -0.001, 45.16), (50.0, 0.0, 499500.0, 0.0, -60.0, 5000900.0)
    t = spark.createDataFrame(tiles(grid, 8, observation="o", band=1), TILE)
    pairs = spark.createDataFrame([("p", "o", (*source, 20, 20, 4326), (*target, 30, 25, 32633))], f"pair string, observation string, source {GRID}, target {GRID}")
    got = V.warp(t, pairs, 8).collect()
    want = warped(grid, source, target, 25, 30, "bilinear", lambda x, y: lonlat(x, y, 33, False))
    assert np.isfinite(want).sum() > 100
    np.testing.assert_allclose(whole(got, 25, 30, 8), want, atol=1e-3)


@pytest.mark.parametrize("accuracy, few", [(K.ACCURACY, K.FEW), (40, 30), (8, 1)])
def test_percentiles_are_exact(spark, accuracy, few):
    """Also where brackets are refined several times, and where the sketches are bad."""
    rng = np.random.default_rng(4)
    values = {"hot": rng.normal(size=4000) * 10.0 ** rng.integers(-5, 12, 4000), "ties": rng.integers(0, 4, 900).astype(float), "one": np.array([7.0]), "same": np.full(50, 2.5), "none": np.full(9, NAN), "inf": np.array([1.0, math.inf, -math.inf, 3.0, 5.0])}
    rows = [(k, [None if math.isnan(x) and i % 2 else float(x) for i, x in enumerate(part)]) for k, v in values.items() for part in np.array_split(v, max(1, len(v) // 64))]
    ranks = (0.0, 0.02, 0.5, 0.98, 1.0)
    got = {r.k: r for r in K.percentiles(spark.createDataFrame(rows, "k string, data array<double>"), ["k"], ranks, accuracy=accuracy, few=few).collect()}
    assert got["none"].p is None and got["none"].valid == 0 and got["none"].cells == 9
    for k, v in values.items():
        if k != "none":
            v = np.sort(v)
            for q, x in zip(ranks, got[k].p):
                at = q * (len(v) - 1)
                lo, hi = v[math.floor(at)], v[math.ceil(at)]
                want = lo if lo == hi or at == math.floor(at) else lo + (at - math.floor(at)) * (hi - lo)
                assert np.isclose(x, want, rtol=1e-12, equal_nan=True), (k, q)


def test_running_sums_take_several_tasks(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(40), rng.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, g int, v int").repartition(7)
    got = K.running(df, [F.col("g").desc(), F.col("i")], {"s": F.col("v").cast("long"), "n": F.lit(1).cast("long")})
    s = 0
    for k, r in enumerate(sorted(got.collect(), key=lambda r: (-r.g, r.i)), 1):
        s += r.v
        assert (r.s, r.n) == (s, k)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "partitionBy" not in plan or "Window [" in plan
    assert K.numbered(df.limit(0), [F.col("i")]).collect() == []


def test_pyramid_equals_means_of_the_whole(spark):
    rng = np.random.default_rng(6)
    rasters = {"a": (37, 21), "b": (8, 8), "c": (1, 70), "d": (3, 2)}
    grids = {k: np.where(rng.random(s) < 0.5, NAN, rng.normal(size=s)) for k, s in rasters.items()}
    t = spark.createDataFrame([x for k, g in grids.items() for x in tiles(g, 8, observation=k)], "observation string, tile_row int, tile_col int, height int, width int, data array<double>")
    got = Y.levels(t, ["observation"], 8, 4).collect()
    for k, g in grids.items():
        level = 0
        while True:
            mine = [r for r in got if r.observation == k and r.level == level]
            np.testing.assert_allclose(whole(mine, *g.shape, 8), g, atol=1e-12)
            assert all((a == 255) == (v is not None) for r in mine for a, v in zip(r.alpha, r.data))
            if max(g.shape) <= 4:
                break
            h, w = g.shape
            padded = np.full((h + h % 2, w + w % 2), NAN)
            padded[:h, :w] = g
            four = padded.reshape((h + 1) // 2, 2, (w + 1) // 2, 2)
            n = (~np.isnan(four)).sum(axis=(1, 3))
            g, level = np.where(n > 0, np.nansum(four, axis=(1, 3)) / np.maximum(n, 1), NAN), level + 1
        assert max(r.level for r in got if r.observation == k) == level


def test_fit_and_pad(spark):
    rng = np.random.default_rng(7)
    images = [(i, w, h, rng.uniform(0, 255, (3 if i % 2 else 1, h, w)), (rng.random((h, w)) < 0.8).astype(int)) for i, (w, h) in enumerate([(9, 5), (3, 4), (20, 3), (1, 1), (6, 6)])]
    df = spark.createDataFrame([(i, w, h, [[float(v) for v in b.ravel()] for b in c], [int(v) for v in a.ravel()]) for i, w, h, c, a in images], "i int, width int, height int, colours array<array<double>>, alpha array<int>")
    W, H, pad = 8, 6, (1, 2, 3)
    got = {r.i: np.array(r.input).reshape(3, H, W) for r in Y.fit_and_pad(df, W, H, pad).collect()}

    def weights(o, n, out):
        scale = n / out
        reach = max(scale, 1.0)
        return np.array([max(0.0, 1 - abs(j + 0.5 - (o + 0.5) * scale) / reach) for j in range(n)])

    for i, w, h, c, a in images:
        s = min(W / w, H / h)
        ow, oh = max(1, round(w * s)), max(1, round(h * s))
        want = np.stack([np.full((H, W), p) for p in pad])
        for b in range(3):
            band = np.where(a > 0, c[b if len(c) == 3 else 0], NAN)
            for y in range(oh):
                for x in range(ow):
                    wx, wy = weights(x, w, ow), weights(y, h, oh)
                    both = np.outer(wy, wx) * ~np.isnan(band)
                    if both.sum() > 0 and a[min(int((y + 0.5) * h / oh), h - 1), min(int((x + 0.5) * w / ow), w - 1)]:
                        want[b, (H - oh) // 2 + y, (W - ow) // 2 + x] = math.floor((np.nan_to_num(band) * both).sum() / both.sum() + 0.5)
        np.testing.assert_array_equal(got[i], want)


def test_boxes_of_very_unequal_sizes(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        w = 10 ** rng.uniform(-2, 3.5)
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        rows.append((i, x, y, x + w, y + w * rng.uniform(0.1, 2)))
    rows += [(400, 0.0, 0.0, 0.0, 5.0), (401, 0.0, 0.0, math.inf, 1.0), (402, None, 0.0, 1.0, 1.0), (403, 0.0, 0.0, 4.0, 4.0), (404, 4.0, 0.0, 8.0, 4.0)]
    got = {(r.a, r.b): r.overlap for r in P.overlapping(spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double")).collect()}
    want = {}
    fine = [r for r in rows if None not in r and r[3] > r[1] and r[4] > r[2] and math.isfinite(r[3])]
    for i, a in enumerate(fine):
        for b in fine[i + 1 :]:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            if w > 0 and h > 0:
                want[a[0], b[0]] = min(1.0, w * h / min((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2])))
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_a_crowded_cell_is_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16, raising=False)
    rng = random.Random(9)
    rows = [(i, x := rng.uniform(1, 900), y := rng.uniform(1, 900), x + rng.uniform(20, 700 if i % 3 else 40), y + rng.uniform(20, 700)) for i in range(150)]
    boxes = spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    got = P.overlapping(boxes).select("a", "b", F.spark_partition_id().alias("task")).collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and max(a[1], b[1]) < min(a[3], b[3]) and max(a[2], b[2]) < min(a[4], b[4])}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want and len({r.task for r in got}) > 1
