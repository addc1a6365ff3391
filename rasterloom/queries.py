"""Registered queries over the driver's tables, each with the SQL that DuckDB runs beside it.

The tables hold no rasters: an ``embeddings`` row of 64 floats serves as an 8 x 8 tile, rows 2k and 2k+1 as the two
times (or bands) of tile k, |v| >= 0.01 as the valid mask and v > 0 as a binary mask.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as X
from .operators import evidence as E
from .operators import metrics as M
from .operators import pairs as P
from .operators import pyramid as PY
from .operators import ranks as RK
from .operators import raster as R
from .operators import selection as S
from .operators import warp as WP
from .plans import intent as I

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, a, b: masked values of both times."""
    e = read(spark, sf_dir, "embeddings")
    data = F.col("embedding").cast("array<double>")
    t = e.select(F.expr("vec_id div 2").alias("tile"), (F.col("vec_id") % 2).alias("k"), R.masked(data, F.transform(data, lambda v: F.abs(v) >= 0.01)).alias("data"))
    return t.where("k = 0").select("tile", F.col("data").alias("a")).join(t.where("k = 1").select("tile", F.col("data").alias("b")), "tile")


# Tiles of both times as DuckDB rows: tile, pos (0 to 63), a, b (null where masked).
_CELLS = """
e AS (SELECT vec_id // 2 AS tile, vec_id % 2 AS k, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
m AS (SELECT tile, k, pos, CASE WHEN abs(v) >= 0.01 THEN v END AS v FROM e),
c AS (SELECT x.tile, x.pos, x.v AS a, y.v AS b FROM m x JOIN m y ON x.tile = y.tile AND x.pos = y.pos AND x.k = 0 AND y.k = 1)
"""
_MICRO = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"


def _pixels(df: DataFrame, *columns: tuple[str, Column]) -> DataFrame:
    """tile, pos and the given arrays, one row a cell."""
    z = F.arrays_zip(*(c.alias(n) for n, c in columns))
    return df.select("tile", F.posexplode(z).alias("pos", "z")).select("tile", "pos", *(F.col(f"z.{n}").alias(n) for n, _ in columns))


@query(f"WITH {_CELLS} SELECT CAST(tile AS BIGINT) AS tile, CAST(pos AS INTEGER) AS pos, {_MICRO.format('(a - b) / nullif(a + b, 0)')} AS nd FROM c")
def spectral_ndvi_tiles(spark, sf_dir):
    t = tile_pairs(spark, sf_dir)
    return _pixels(t, ("nd", R.spectral_index("ndvi", {"nir": F.col("a"), "red": F.col("b")}))).select("tile", "pos", N.micro(F.col("nd")).alias("nd"))


@query(
    f"""WITH {_CELLS}, n AS (SELECT tile, (a - b) / nullif(a + b, 0) AS v FROM c)
    SELECT CAST(tile AS BIGINT) AS tile, count(v) AS valid, count(*) AS cells, {_MICRO.format('min(v)')} AS lo, {_MICRO.format('max(v)')} AS hi,
      {_MICRO.format('quantile_cont(v, 0.02)')} AS p02, {_MICRO.format('quantile_cont(v, 0.5)')} AS p50, {_MICRO.format('quantile_cont(v, 0.98)')} AS p98 FROM n GROUP BY tile"""
)
def spectral_index_summary(spark, sf_dir):
    t = tile_pairs(spark, sf_dir).withColumn("v", R.spectral_index("ndvi", {"nir": F.col("a"), "red": F.col("b")}))
    p = RK.percentiles(t.select("tile", "v"), ["tile"], (0.02, 0.5, 0.98), data="v")
    return p.select("tile", F.col("valid").cast("long"), F.col("cells").cast("long"), N.micro(F.col("min")).alias("lo"), N.micro(F.col("max")).alias("hi"), *(N.micro(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(("p02", "p50", "p98"))))


@query(f"WITH {_CELLS} SELECT CAST(tile AS BIGINT) AS tile, CAST(pos AS INTEGER) AS pos, {_MICRO.format('b - a')} AS difference FROM c")
def temporal_difference_signed(spark, sf_dir):
    t = tile_pairs(spark, sf_dir)
    return _pixels(t, ("d", R.temporal_difference(F.col("a"), F.col("b")))).select("tile", "pos", N.micro(F.col("d")).alias("difference"))


@query(
    f"""WITH {_CELLS} SELECT CAST(tile AS BIGINT) AS tile, count(*) FILTER (abs(b - a) >= 0.1) AS n_absolute, count(*) FILTER (b - a >= 0.1) AS n_increase,
    count(*) FILTER (a - b >= 0.1) AS n_decrease FROM c GROUP BY tile"""
)
def temporal_thresholds(spark, sf_dir):
    t = tile_pairs(spark, sf_dir).withColumn("d", R.temporal_difference(F.col("a"), F.col("b")))
    return t.select("tile", *(R.count_true(R.threshold_mask(F.col("d"), 0.1, k)).alias(f"n_{k}") for k in R.DIRECTIONS))


def _four(spark, sf_dir):
    """tile, and two polarisations at two times: tiles 2k and 2k+1."""
    t = tile_pairs(spark, sf_dir)
    x = t.where("tile % 2 = 0").select((F.col("tile") / 2).cast("long").alias("tile"), F.col("a").alias("p1"), F.col("b").alias("p2"))
    y = t.where("tile % 2 = 1").select(F.expr("tile div 2").alias("tile"), F.col("a").alias("q1"), F.col("b").alias("q2"))
    return x.join(y, "tile")


_FOUR = _CELLS + ", f AS (SELECT p.tile // 2 AS tile, p.pos, p.a AS p1, p.b AS p2, q.a AS q1, q.b AS q2 FROM c p JOIN c q ON p.tile % 2 = 0 AND q.tile = p.tile + 1 AND p.pos = q.pos)"


@query(
    f"""WITH {_FOUR}, s AS (SELECT tile, CASE WHEN p1 + p2 + q1 + q2 IS NOT NULL THEN greatest(abs(p2 - p1), abs(q2 - q1)) END AS s FROM f)
    SELECT CAST(tile AS BIGINT) AS tile, count(s) AS valid, count(*) FILTER (s >= 0.1) AS changed, {_MICRO.format('max(coalesce(s, 0))')} AS top FROM s GROUP BY tile"""
)
def sar_change_db(spark, sf_dir):
    f = _four(spark, sf_dir).withColumn("r", R.radar_change([(F.col("p1"), F.col("p2")), (F.col("q1"), F.col("q2"))], "db", 0.1))
    return f.select("tile", R.count_true(F.col("r.valid")).alias("valid"), R.count_true(F.col("r.mask")).alias("changed"), N.micro(F.array_max("r.score")).alias("top"))


@query(
    f"""WITH {_FOUR}, s AS (SELECT tile, CASE WHEN p1 + p2 + q1 + q2 IS NOT NULL THEN
      greatest(abs(ln((p2*p2 + 1e-6) / (p1*p1 + 1e-6))), abs(ln((q2*q2 + 1e-6) / (q1*q1 + 1e-6)))) END AS s FROM f)
    SELECT CAST(tile AS BIGINT) AS tile, count(s) AS valid, count(*) FILTER (s >= 1.0) AS changed FROM s GROUP BY tile"""
)
def sar_change_linear(spark, sf_dir):
    square = lambda c: F.transform(c, lambda v: v * v)
    f = _four(spark, sf_dir).withColumn("r", R.radar_change([(square("p1"), square("p2")), (square("q1"), square("q2"))], "linear_power", 1.0))
    return f.select("tile", R.count_true(F.col("r.valid")).alias("valid"), R.count_true(F.col("r.mask")).alias("changed"))


@query(
    f"""WITH {_CELLS}, k AS (SELECT tile, count(*) FILTER (a > 0 AND b > 0) AS i, count(*) FILTER (a > 0 OR b > 0) AS u, count(*) AS v FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY tile)
    SELECT CAST(tile AS BIGINT) AS tile, i AS intersection, u AS "union", v AS valid, {_MICRO.format('i / nullif(u, 0)')} AS iou FROM k"""
)
def mask_agreement_iou(spark, sf_dir):
    t = tile_pairs(spark, sf_dir)
    positive = lambda c: F.transform(c, lambda v: F.coalesce(v > 0, F.lit(False)))
    valid = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull())
    t = t.withColumn("g", R.mask_agreement(positive("a"), positive("b"), valid))
    return t.select("tile", "g.intersection", "g.union", "g.valid", N.micro(F.col("g.iou")).alias("iou"))


def _tiles(spark, sf_dir):
    """tile, a: masked values of every tile."""
    data = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile"), R.masked(data, F.transform(data, lambda v: F.abs(v) >= 0.01)).alias("a"))


# Every tile as DuckDB rows: tile, pos, a (null where masked).
_ALL = """e AS (SELECT vec_id AS tile, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
c AS (SELECT tile, pos, CASE WHEN abs(v) >= 0.01 THEN v END AS a FROM e)"""


@query(
    f"""WITH {_ALL}, n AS (SELECT tile, count(*) FILTER (a > 0) AS n FROM c GROUP BY tile)
    SELECT CAST(tile AS BIGINT) AS tile, n, CAST(n * 100 AS DOUBLE) AS m2, {_MICRO.format('n * 100 / 1e4')} AS ha, {_MICRO.format('n * 100 / 1e6')} AS km2 FROM n"""
)
def mask_area_projected(spark, sf_dir):
    t = _tiles(spark, sf_dir).select("tile", R.count_true(F.transform("a", lambda v: F.coalesce(v > 0, F.lit(False)))).alias("n"))
    grid = F.struct(*(F.lit(v).alias(k) for k, v in zip("abcdef", (10.0, 0.0, 0.0, 0.0, -10.0, 100.0))))
    return t.select("tile", "n", R.projected_area(F.col("n"), grid).alias("m2"), *(N.micro(R.projected_area(F.col("n"), grid, u)).alias(u) for u in ("ha", "km2")))


_F = 1 / 298.257223563
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)
_UPTO = f"(sin(radians({{0}})) / (2 * (1 - {_E2!r} * sin(radians({{0}})) * sin(radians({{0}})))) + atanh(sin(radians({{0}})) * {_E!r}) / (2 * {_E!r}))"


@query(
    f"""WITH {_ALL}, r AS (SELECT tile, pos // 8 AS r, count(*) FILTER (a > 0) AS n FROM c GROUP BY ALL)
    SELECT CAST(tile AS BIGINT) AS tile, CAST(floor(sum(n * {math.radians(0.01)!r} * {6378137.0**2 * (1 - _E2)!r} * ({_UPTO.format('60 - r * 0.01')} - {_UPTO.format('60 - r * 0.01 - 0.01')})) + 0.5) AS BIGINT) AS m2 FROM r GROUP BY tile"""
)
def mask_area_ellipsoidal(spark, sf_dir):
    t = _tiles(spark, sf_dir).withColumn("mask", F.transform("a", lambda v: F.coalesce(v > 0, F.lit(False))))
    return t.select("tile", F.floor(R.ellipsoidal_area(F.col("mask"), 8, F.lit(60.0), 0.01) + 0.5).cast("long").alias("m2"))


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS intersection, count(*) FILTER (quality = 1 OR toxic = 1) AS \"union\", count(*) AS valid FROM labels")
def label_mask_agreement(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return read(spark, sf_dir, "labels").agg(F.count_if(q & t).alias("intersection"), F.count_if(q | t).alias("union"), F.count("*").alias("valid"))


def _every_second(spark, sf_dir, method):
    """Every tile as a raster of its own, on a grid of cells twice as wide and high, 0.25 cells to the right and above."""
    grid = lambda size, *v: F.struct(*(F.lit(x).alias(k) for k, x in zip("abcdef", v)), F.lit(size).alias("width"), F.lit(size).alias("height"), F.lit(3857).alias("crs"))
    t = _tiles(spark, sf_dir).select(F.col("tile").alias("observation"), F.lit(1).alias("band"), F.lit(0).alias("tile_row"), F.lit(0).alias("tile_col"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("a").alias("data"))
    pairs = t.select(F.col("observation").alias("pair"), "observation", grid(8, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0).alias("source"), grid(4, 2.0, 0.0, 0.25, 0.0, 2.0, -0.25).alias("target"))
    w = WP.warp(t, pairs, 8, method)
    return w.select(F.col("pair").alias("tile"), F.posexplode("data").alias("pos", "value")).select("tile", F.expr("cast(pos div 4 as int)").alias("row"), (F.col("pos") % 4).alias("col"), N.micro(F.col("value")).alias("value"))


_TARGETS = "g AS (SELECT i // 4 AS r, i % 4 AS q, (i // 4) * 2 + 0.25 AS sr, (i % 4) * 2 + 0.75 AS sc FROM range(16) t(i))"


@query(f"WITH {_ALL}, {_TARGETS} SELECT CAST(tile AS BIGINT) AS tile, CAST(r AS INTEGER) AS \"row\", CAST(q AS INTEGER) AS col, {_MICRO.format('a')} AS value FROM g JOIN c ON pos = floor(sr + 0.5) * 8 + floor(sc + 0.5)")
def resample_nearest(spark, sf_dir):
    return _every_second(spark, sf_dir, "nearest")


@query(
    f"""WITH {_ALL}, {_TARGETS}, t AS (SELECT r, q, floor(sr) + i AS y, floor(sc) + j AS x, (CASE i WHEN 1 THEN sr - floor(sr) ELSE 1 - sr + floor(sr) END) * (CASE j WHEN 1 THEN sc - floor(sc) ELSE 1 - sc + floor(sc) END) AS w
      FROM g, range(2) a(i), range(2) b(j))
    SELECT CAST(tile AS BIGINT) AS tile, CAST(r AS INTEGER) AS "row", CAST(q AS INTEGER) AS col, {_MICRO.format('sum(a * w) / nullif(sum(w) FILTER (a IS NOT NULL), 0)')} AS value
    FROM t JOIN c ON pos = y * 8 + x AND x < 8 AND y < 8 WHERE w > 0 GROUP BY tile, r, q"""
)
def resample_bilinear_masked(spark, sf_dir):
    return _every_second(spark, sf_dir, "bilinear")


@query(
    f"""WITH {_ALL}, q AS (SELECT tile, quantile_cont(a, 0.02) AS lo, quantile_cont(a, 0.98) AS hi FROM c GROUP BY tile)
    SELECT CAST(tile AS BIGINT) AS tile, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN a IS NULL THEN 0 WHEN hi <= lo THEN 128 ELSE trunc(least(greatest((a - lo) / (hi - lo) * 255, 0), 255)) END AS INTEGER) AS byte FROM c JOIN q USING (tile)"""
)
def display_stretch(spark, sf_dir):
    t = _tiles(spark, sf_dir)
    q = RK.percentiles(t, ["tile"], (0.02, 0.98), data="a").select("tile", F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))
    bytes_ = F.transform("a", lambda v: N.stretch_to_byte(v, F.col("lo"), F.col("hi")))
    return t.join(q, "tile").select("tile", F.posexplode(bytes_).alias("pos", "byte"))


@query(f"WITH {_ALL} SELECT CAST(tile AS BIGINT) AS tile, CAST(pos // 16 AS INTEGER) AS \"row\", CAST(pos % 8 // 2 AS INTEGER) AS col, {_MICRO.format('avg(a)')} AS value FROM c GROUP BY ALL")
def decimated_tiles(spark, sf_dir):
    t = _tiles(spark, sf_dir).select("tile", F.posexplode(PY.halved(F.col("a"), F.lit(8), F.lit(8))).alias("pos", "value"))
    return t.select("tile", F.expr("cast(pos div 4 as int)").alias("row"), (F.col("pos") % 4).alias("col"), N.micro(F.col("value")).alias("value"))


_HALF = math.pi * 6378137.0


@query(
    f"""WITH z AS (SELECT c_custkey, z, c_custkey * 7919 % (1 << CAST(z AS INTEGER)) AS x, c_custkey * 104729 % (1 << CAST(z AS INTEGER)) AS y, {2 * _HALF!r} / pow(2, z) AS s FROM (SELECT c_custkey, c_custkey % 20 AS z FROM customer))
    SELECT c_custkey, z, x, y, CAST(floor(x * s - {_HALF!r} + 0.5) AS BIGINT) AS "left", CAST(floor({_HALF!r} - (y + 1) * s + 0.5) AS BIGINT) AS bottom, CAST(floor((x + 1) * s - {_HALF!r} + 0.5) AS BIGINT) AS "right", CAST(floor({_HALF!r} - y * s + 0.5) AS BIGINT) AS top FROM z"""
)
def tile_grid_xyz(spark, sf_dir):
    """The bounds of one tile a customer, at levels 0 to 19."""
    k, z = F.col("c_custkey"), F.col("c_custkey") % 20
    side = F.pow(F.lit(2.0), z).cast("long")
    t = read(spark, sf_dir, "customer").select("c_custkey", z.alias("z"), (k * 7919 % side).alias("x"), (k * 104729 % side).alias("y"))
    b = N.mercator_tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return t.select("c_custkey", "z", "x", "y", *(F.floor(b[c] + 0.5).cast("long").alias(c) for c in ("left", "bottom", "right", "top")))


@query(
    f"""WITH b AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101) / 10.0 AS x1, (s_suppkey * 53 % 97) / 10.0 AS y1, 0.3 + s_nationkey / 10.0 AS w FROM supplier),
    p AS (SELECT a.id AS a, b.id AS b, least(a.x1 + a.w, b.x1 + b.w) - greatest(a.x1, b.x1) AS w, least(a.y1 + a.w, b.y1 + b.w) - greatest(a.y1, b.y1) AS h, least(a.w * a.w, b.w * b.w) AS m FROM b a JOIN b ON a.id < b.id)
    SELECT a, b, {_MICRO.format('least(w * h / m, 1)')} AS overlap FROM p WHERE w > 1e-9 AND h > 1e-9"""
)
def bbox_overlap_pairs(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    b = s.select(k.alias("id"), (k * 37 % 101 / 10.0).alias("x1"), (k * 53 % 97 / 10.0).alias("y1"), (F.col("s_nationkey") / 10.0 + 0.3).alias("w"))
    b = b.select("id", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("w")).alias("y2"), (F.col("w") * F.col("w")).alias("area"))
    found = P.overlapping(b, area="area", least=1e-9)
    return found.select("a", "b", N.micro(F.col("overlap")).alias("overlap"))


@query(
    """WITH o AS (SELECT o_custkey AS k, o_orderkey AS a, lead(o_orderkey) OVER w AS b, o_orderdate AS t, lead(o_orderdate) OVER w AS u, o_orderstatus AS s, lead(o_orderstatus) OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    f AS (SELECT *, s = r AS same, CASE WHEN t = u THEN 0.0 WHEN date_diff('day', CAST(t AS TIMESTAMP), CAST(u AS TIMESTAMP)) < 365 THEN 0.5 END AS overlap FROM o WHERE b IS NOT NULL)
    SELECT a, b, CASE WHEN overlap = 0 THEN 'INVALID' WHEN same AND overlap IS NOT NULL THEN 'VERIFIED' WHEN overlap > 0 THEN 'APPROXIMATE' ELSE 'UNKNOWN' END AS registration,
      CASE WHEN overlap = 0 THEN 'FAIL' WHEN NOT same OR overlap IS NULL THEN 'WARN' ELSE 'PASS' END AS status FROM f"""
)
def pair_validate_status(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = o.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b"), F.col("o_orderdate").alias("t"), F.lead("o_orderdate").over(w).alias("u"), F.col("o_orderstatus").alias("s"), F.lead("o_orderstatus").over(w).alias("r")).where("b is not null")
    overlap = F.when(F.col("t") == F.col("u"), 0.0).when(F.datediff("u", "t") < 365, 0.5)
    same, yes = F.col("s") == F.col("r"), F.lit(True)
    why = P.reasons(CRS_DIFFERS=~same, OVERLAP_UNKNOWN=overlap.isNull())
    return o.select("a", "b", P.registration_status(yes, same, overlap, overlap.isNotNull(), yes).alias("registration"), P.overall_status(yes, overlap, why).alias("status"))


_DECIDE = "WITH d AS (SELECT doc_id, lang, quality AS target, (n_chars % 1000) / 1000.0 AS score FROM documents JOIN labels USING (doc_id))"


def _decisions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", F.col("quality").alias("target"), (F.col("n_chars") % 1000 / 1000.0).alias("score"))


@query(
    f"""{_DECIDE}, k AS (SELECT lang, count(*) FILTER (score >= 0.5 AND target = 1) AS tp, count(*) FILTER (score >= 0.5 AND target <> 1) AS fp, count(*) FILTER (score < 0.5 AND target = 1) AS fn FROM d GROUP BY lang)
    SELECT {_MICRO.format('avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0))')} AS macro_f1, {_MICRO.format('coalesce(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0)')} AS micro_f1, count(*) AS labels FROM k"""
)
def multilabel_f1(spark, sf_dir):
    f = M.multilabel_f1(_decisions(spark, sf_dir), "lang")
    return f.select(N.micro(F.col("macro_f1")).alias("macro_f1"), N.micro(F.col("micro_f1")).alias("micro_f1"), "labels")


@query(
    f"""{_DECIDE}, t AS (SELECT lang, score, sum(target) AS tp, count(*) AS n FROM d GROUP BY ALL), r AS (SELECT lang, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY lang) AS al FROM t WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
    SELECT lang, {_MICRO.format('coalesce(sum(tp / nullif(al, 0) * ctp / cn), 0)')} AS ap FROM r GROUP BY lang"""
)
def average_precision(spark, sf_dir):
    return M.average_precision(_decisions(spark, sf_dir), "lang").select("lang", N.micro(F.col("ap")).alias("ap"))


@query(
    f"""{_DECIDE}, x AS (SELECT target, CAST(score >= 0.3 AS INTEGER) AS a, CAST(score >= 0.6 AS INTEGER) AS b FROM d)
    SELECT count(*) FILTER (a = target AND b = target) AS "both", count(*) FILTER (a = target AND b <> target) AS first_only, count(*) FILTER (a <> target AND b = target) AS second_only, count(*) FILTER (a <> target AND b <> target) AS neither,
      count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties FROM x"""
)
def paired_correctness(spark, sf_dir):
    d = _decisions(spark, sf_dir).select("target", (F.col("score") >= 0.3).cast("int").alias("a"), (F.col("score") >= 0.6).cast("int").alias("b"))
    return d.agg(*M.paired_correctness(F.col("a"), F.col("b"), F.col("target")), *M.win_tie(F.col("a"), F.col("b")))


_CUTS = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4)


@query(
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
    d AS (SELECT vec_id, unnest(range(8)) AS i, x FROM e), k AS (SELECT vec_id, i, abs(x[i * 8 + 1]) AS score, abs(x[i * 8 + 2]) * 4 AS area, abs(x[i * 8 + 3]) * 3 AS iou FROM d),
    c AS (SELECT vec_id, t.t, arg_max(iou, (score, -i)) FILTER (score >= t.t AND area < 0.8) AS iou FROM k, (VALUES {", ".join(f"(CAST({c} AS DOUBLE))" for c in _CUTS)}) t(t) GROUP BY ALL)
    SELECT t AS threshold, {_MICRO.format('avg(coalesce(iou, 0))')} AS mean_iou, count(*) FILTER (coalesce(iou, 0) >= 0.5) AS hits, count(*) FILTER (iou IS NULL) AS no_detection, {_MICRO.format('avg(iou)')} AS detected_mean, count(*) AS n FROM c GROUP BY t"""
)
def threshold_sweep(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    box = lambda i: F.struct(F.abs(F.get("x", i * 8)).alias("score"), (F.abs(F.get("x", i * 8 + 1)) * 4).alias("area"), (F.abs(F.get("x", i * 8 + 2)) * 3).alias("iou"))
    c = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), box).alias("c"))
    best = F.array(*(F.struct(F.lit(t).alias("threshold"), M.best_detection(F.col("c"), t, 0.8)["iou"].alias("iou")) for t in _CUTS))
    rows = c.select("vec_id", F.explode(best).alias("b")).select("vec_id", "b.threshold", "b.iou", F.lit(False).alias("huge"))
    s = M.grounding_summary(rows, ["threshold"])
    return s.select("threshold", N.micro(F.col("mean_iou")).alias("mean_iou"), F.round(F.col("acc_50") * F.col("n")).cast("long").alias("hits"), "no_detection", N.micro(F.col("detected_mean")).alias("detected_mean"), "n")


@query(
    """WITH t AS (SELECT * FROM events WHERE event_id % 10 < 8), c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM t GROUP BY ALL),
    m AS (SELECT user_id, arg_min(event_type, (-n, f)) AS guess FROM c GROUP BY user_id), g AS (SELECT event_type AS fallback FROM t GROUP BY event_type ORDER BY count(*) DESC, min(event_id) LIMIT 1)
    SELECT e.event_id, coalesce(m.guess, g.fallback) AS guess, e.event_type = coalesce(m.guess, g.fallback) AS correct FROM events e LEFT JOIN m USING (user_id), g WHERE e.event_id % 10 >= 8"""
)
def majority_by_group_fallback(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    train = e.where("event_id % 10 < 8")
    m = M.majority(train, ["user_id"], "event_type", "event_id")
    g = M.majority(train.withColumn("all", F.lit(1)), ["all"], "event_type", "event_id").select(F.col("majority").alias("fallback"))
    guess = F.coalesce("majority", "fallback")
    return e.where("event_id % 10 >= 8").join(m, "user_id", "left").crossJoin(F.broadcast(g)).select("event_id", guess.alias("guess"), (F.col("event_type") == guess).alias("correct"))


@query("WITH d AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, CAST(floor(n / sum(n) OVER () * 1e6 + 0.5) AS BIGINT) AS share FROM d")
def value_distribution(spark, sf_dir):
    return M.distribution(read(spark, sf_dir, "events"), "event_type").select("event_type", "n", N.micro(F.col("share")).alias("share"))


@query("SELECT event_id, user_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM events) ORDER BY depth, user_id LIMIT 50")
def scene_round_robin(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    return S.round_robin(e, "user_id", [F.col("event_id")], 50).withColumn("depth", F.col("depth").cast("long"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")
def first_k_per_group(spark, sf_dir):
    return S.first_per_group(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 2)


@query("SELECT o_custkey, o_orderkey FROM orders SEMI JOIN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY min(o_orderkey), o_custkey LIMIT 12) USING (o_custkey)")
def first_n_groups(spark, sf_dir):
    return S.first_groups(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 12)


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1")
def split_leakage(spark, sf_dir):
    return S.leakage(read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 3).alias("split")), "o_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT') USING (c_custkey)")
def exclude_used_scenes(spark, sf_dir):
    used = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(used, "c_custkey", "left_anti")


@query(
    """WITH k AS (SELECT *, sha256('seed' || chr(0) || CAST(c_custkey AS VARCHAR)) AS h FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY h, c_custkey) - 1 AS r, count(*) OVER () AS n FROM k)
    SELECT c_custkey, CASE WHEN r * 100 < n * 80 THEN 'train' WHEN r * 100 < n * 90 THEN 'validation' ELSE 'test' END AS split FROM r"""
)
def hash_split(spark, sf_dir):
    return S.assign_split(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "seed", (80, 10))


@query(
    """WITH b AS (SELECT user_id AS g, event_type AS b, event_id AS o, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
    m AS (SELECT g, max(n) AS most FROM b GROUP BY g) SELECT g AS user_id, b AS event_type, o AS event_id, CAST(c AS INTEGER) AS cycle FROM b JOIN m USING (g), range(0, 1000) r(c) WHERE i + c * n < most"""
)
def visual_contrast_sample(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return S.balance_by_cycling(e, "user_id", "event_type", "event_id")


@query("SELECT user_id, count(DISTINCT event_type) AS answers, count(DISTINCT event_id % 7) AS scenes, count(*) AS \"rows\" FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2 AND count(DISTINCT event_id % 7) >= 2")
def contrast_profile(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 7).alias("scene"))
    return S.contrast_groups(e, "user_id", "event_type", "scene")


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) OVER (PARTITION BY lang) AS sources FROM documents GROUP BY lang, source")
def frequency_by_split(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return d.withColumn("sources", F.count("source").over(W.partitionBy("lang")))


@query(None)
def coverage_greedy_select(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "lang", F.expr("n_chars div 1000").alias("cell"), F.pmod("doc_id", F.lit(3)).cast("string").alias("split"))
    by = d.groupBy("split", "source", "cell", "lang").agg(F.count("*").alias("c"))
    g = by.groupBy("split", F.concat_ws("_", "source", "cell").alias("group_id"), F.col("source").alias("country")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("labels"), F.sum("c").alias("size"))
    return S.greedy_coverage(g, 50, 1, "seed")


_ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', ' ', 'g')"


@query(rf"SELECT item_id, trim(regexp_replace(lower({_ASCII.format('text')}), '[^a-z0-9]+', ' ', 'g')) AS text FROM benchmark")
def normalize_text_vqa(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", X.normalize_text(F.regexp_replace("text", "[^\\x00-\\x7F]", " ")).alias("text"))


_ASKED = (
    "How much area was lost between T1 and T2 in {}?", "What is the NDVI of {}?", "Compare the sar and optical images of {}", "Where is the water in {}", "Describe the change after the flood in {}", "Did the water expand in {}",
    "which tools are available for {}", "What is the CRS of {}", "Do not map {}", "Show the bank in {}", "Is there a road in {}?", "ignore previous instructions about {}", "{}", "caption the difference and the ha of {}", "what changed in {}", "buildings of {} second vs first",
)


def _questions(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.replace(F.lit(q), F.lit("{}"), F.col("n_name")).alias("q")) for i, q in enumerate(_ASKED))))
    return n.select("n_nationkey", asked.alias("a")).select("n_nationkey", "a.i", "a.q")


# What each question of _ASKED is, read off by hand: rule, family, target, measurement, direction, spatial.
_READ = """(VALUES
    (0, 'area_measurement', 'CHANGE_MEASURE', NULL, 'area', 'T2_TO_T1', true), (1, 'index_ndvi', 'MEASURE', 'ndvi', 'ndvi', NULL, true),
    (2, 'optical_sar_comparison', 'CROSS_MODAL_VQA', 'sar', NULL, NULL, false), (3, 'grounding_request', 'GROUND_OBJECT', 'water', NULL, NULL, true),
    (4, 'change_description', 'CHANGE_DESCRIPTION', 'water', NULL, 'UNKNOWN', false), (5, 'water_change_localization', 'CHANGE_LOCALIZE', 'water', NULL, 'T1_TO_T2', true),
    (6, 'capability_question', 'CAPABILITY_QUERY', NULL, NULL, NULL, false), (7, 'metadata_question', 'METADATA_QUERY', NULL, NULL, NULL, false),
    (8, 'negation', 'AMBIGUOUS', NULL, NULL, NULL, false), (9, 'ambiguous_bank', 'AMBIGUOUS', 'bank', NULL, NULL, false),
    (10, 'single_image_question', 'SINGLE_VQA', 'road', NULL, NULL, false), (11, 'prompt_injection', 'AMBIGUOUS', NULL, NULL, NULL, false),
    (12, 'no_matching_rule', 'AMBIGUOUS', NULL, NULL, NULL, false), (13, 'conflicting_intents', 'AMBIGUOUS', NULL, 'area', 'UNKNOWN', true),
    (14, 'temporal_change_question', 'CHANGE_VQA', NULL, NULL, 'UNKNOWN', false), (15, 'temporal_change_question', 'CHANGE_VQA', 'building', NULL, 'T2_TO_T1', false))
    r(i, matched_rule, task_family, target_semantic, requested_measurement, temporal_direction, spatial_request)"""


@query(f"SELECT n_nationkey, r.* FROM nation, {_READ}")
def interpret_queries(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumn("x", I.interpret(F.col("q")))
    return q.select("n_nationkey", "i", *(F.col(f"x.{c}") for c in ("matched_rule", "task_family", "target_semantic", "requested_measurement", "temporal_direction", "spatial_request")))


@query(
    f"""SELECT n_nationkey, i, task_family, CASE WHEN task_family IN ('CROSS_MODAL_VQA', 'GROUND_OBJECT', 'CHANGE_DESCRIPTION', 'SINGLE_VQA') OR requested_measurement = 'ndvi' THEN 'REJECT'
      WHEN task_family LIKE 'CHANGE%' AND n_nationkey % 3 = 0 THEN 'REQUEST_INPUT' ELSE 'ALLOW' END AS outcome FROM nation, {_READ}"""
)
def feasibility_matrix(spark, sf_dir):
    """What each intent calls for against what is available: the worst outcome of all checks."""
    q = _questions(spark, sf_dir).withColumn("x", I.interpret(F.col("q"))).select("n_nationkey", "i", "x.*")
    need = I.required_capabilities(F.col("task_family"), F.col("target_semantic"), F.col("requested_measurement"))
    have = F.array(*map(F.lit, ("deterministic_sar_temporal_change", "mask_area_measurement", "temporal_difference")))
    ranks = F.array(
        F.when(F.size(F.array_except(need, have)) > 0, F.struct(F.lit(4).alias("rank"), F.lit("REJECT").alias("outcome"), F.lit("CAPABILITY_UNAVAILABLE").alias("code"))),
        F.when(F.col("task_family").startswith("CHANGE") & (F.col("n_nationkey") % 3 == 0), F.struct(F.lit(3).alias("rank"), F.lit("REQUEST_INPUT").alias("outcome"), F.lit("MISSING_TEMPORAL_PAIR").alias("code"))),
        F.struct(F.lit(0).alias("rank"), F.lit("ALLOW").alias("outcome"), F.lit(None).cast("string").alias("code")),
    )
    return q.select("n_nationkey", "i", "task_family", F.array_max(F.filter(ranks, lambda r: r.isNotNull()))["outcome"].alias("outcome"))


@query(
    """WITH q AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Is it a rural or an urban area?' WHEN 1 THEN 'How many roads are there?' WHEN 2 THEN 'Are there more roads than rivers?' WHEN 3 THEN 'Is there a road?' ELSE p_name END AS q FROM part),
    n AS (SELECT p_partkey, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS t FROM q)
    SELECT CASE WHEN contains(t, 'rural or an urban') THEN 'rural_urban' WHEN starts_with(t, 'how many ') OR starts_with(t, 'what is the amount ') OR starts_with(t, 'what is the number ') THEN 'count'
      WHEN starts_with(t, 'are there more ') OR starts_with(t, 'are there less ') OR (starts_with(t, 'is the number ') AND contains(t, ' equal to ')) THEN 'comparison'
      WHEN starts_with(t, 'is there ') OR contains(t, ' present') THEN 'presence' ELSE 'other' END AS kind, count(*) AS n FROM n GROUP BY 1"""
)
def question_type_mix(spark, sf_dir):
    k = F.col("p_partkey") % 5
    q = F.when(k == 0, "Is it a rural or an urban area?").when(k == 1, "How many roads are there?").when(k == 2, "Are there more roads than rivers?").when(k == 3, "Is there a road?").otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(X.question_type(q).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH b AS (SELECT p_partkey, p_partkey % 90 AS a, p_partkey % 70 AS b, p_partkey % 120 AS c, p_partkey % 100 AS d FROM part)
    SELECT p_partkey, CASE WHEN c <= 100 AND a < c AND b < d THEN {_MICRO.format('a / 100.0')} END AS x1, CASE WHEN c <= 100 AND a < c AND b < d THEN {_MICRO.format('d / 100.0')} END AS y2 FROM b"""
)
def parse_box(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("{"), *(F.concat(F.lit("<"), (k % m).cast("string"), F.lit(">")) for m in (90, 70, 120, 100)), F.lit("}"))
    return read(spark, sf_dir, "part").select("p_partkey", X.parse_box(text).alias("b")).select("p_partkey", N.micro(F.col("b.x1")).alias("x1"), N.micro(F.col("b.y2")).alias("y2"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (SELECT (o_orderdate, o_orderkey) FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 99) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def keyset_page(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    last = E.page(o, "o_orderdate", "o_orderkey", 100).orderBy("o_orderdate", "o_orderkey").first()
    return E.page(o, "o_orderdate", "o_orderkey", 100, (last.o_orderdate, last.o_orderkey)).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'")
def trace_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def analyses_filter(spark, sf_dir):
    used = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(used, "c_custkey", "left_semi")


@query(
    """WITH e AS (SELECT l_orderkey AS k, l_linenumber - 1 + CASE WHEN l_orderkey % 5 = 0 AND l_linenumber > 2 THEN 1 ELSE 0 END AS n FROM lineitem),
    g AS (SELECT k, n, lag(n) OVER (PARTITION BY k ORDER BY n) AS p FROM e) SELECT k, n FROM g WHERE n <> coalesce(p + 1, 0)"""
)
def event_contiguity(spark, sf_dir):
    """Line numbers as sequences, with a number left out in every fifth order of over two lines."""
    skipped = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") > 2), 1).otherwise(0)
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1 + skipped).alias("n"))
    return E.sequence_gaps(e, "k", "n").select("k", "n")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_state(spark, sf_dir):
    return E.latest(read(spark, sf_dir, "events"), "user_id", F.col("event_id"), "event_type", "event_id")


@query(
    """WITH s AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'CANCEL_REQUESTED' ELSE 'SUCCEEDED' END AS state FROM events),
    b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
    SELECT event_id, before, state FROM b WHERE before IS NOT NULL AND NOT ((before = 'QUEUED' AND state IN ('RUNNING', 'FAILED', 'CANCELLED')) OR (before = 'RUNNING' AND state IN ('SUCCEEDED', 'FAILED', 'CANCEL_REQUESTED', 'INTERRUPTED')) OR (before = 'CANCEL_REQUESTED' AND state IN ('CANCELLED', 'FAILED', 'INTERRUPTED')))"""
)
def illegal_transitions(spark, sf_dir):
    k = F.col("event_id") % 4
    s = read(spark, sf_dir, "events").select("event_id", "user_id", F.when(k == 0, "QUEUED").when(k == 1, "RUNNING").when(k == 2, "CANCEL_REQUESTED").otherwise("SUCCEEDED").alias("state"))
    return E.illegal_transitions(s, "user_id", "event_id", "state", E.JOB_TRANSITIONS).select("event_id", "before", "state")


@query(
    """SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target, 'DERIVED_FROM' AS edge_type FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'MEASURED_FROM' FROM supplier"""
)
def edge_derive(spark, sf_dir):
    return E.derive_edges(_nodes(spark, sf_dir))


def _nodes(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    none = F.lit(None).cast("string")
    row = lambda task, i, source, parents: [i.alias("evidence_id"), F.lit(task).alias("task"), source.alias("source_evidence_id"), none.alias("first_evidence_id"), none.alias("second_evidence_id"), parents.alias("parents")]
    empty = F.array().cast("array<string>")
    regions = read(spark, sf_dir, "region").select(*row("flood_segmentation", key("r", "r_regionkey"), none, empty))
    nations = read(spark, sf_dir, "nation").select(*row("change_localize", key("n", "n_nationkey"), none, F.array(key("r", "n_regionkey"), key("n", "n_nationkey"))))
    suppliers = read(spark, sf_dir, "supplier").select(*row("measurement", key("s", "s_suppkey"), key("n", "s_nationkey"), F.array(key("r", "s_suppkey"))))
    return regions.unionByName(nations).unionByName(suppliers)


@query(
    """SELECT 's' || s_suppkey AS evidence_id, CASE WHEN s_suppkey % 7 = 5 THEN 'MISSING_SOURCE' WHEN s_suppkey % 7 = 6 THEN 'WRONG_SOURCE_TYPE'
      WHEN s_suppkey % 4 = 0 THEN 'NOT_RECOMPUTED' WHEN s_suppkey % 4 = 1 THEN 'VALUE_MISMATCH' ELSE 'VALID' END AS outcome FROM supplier"""
)
def evidence_verify(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    value = F.when(F.col("task") == "measurement", F.substring("evidence_id", 2, 20).cast("double"))
    again = n.where("task = 'measurement'").select("evidence_id", value.alias("v")).where("v % 4 <> 0").select("evidence_id", (F.col("v") + F.when(F.col("v") % 4 == 1, 0.5).otherwise(0.0)).alias("value"))
    n = n.withColumn("value", value)
    source = F.when(F.col("value") % 7 == 5, "nowhere").when(F.col("value") % 7 == 6, F.col("evidence_id")).otherwise(F.col("source_evidence_id"))
    return E.verify_measurements(n.withColumn("source_evidence_id", source), again)


@query("SELECT 'n' || n_nationkey AS node FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey < 3")
def cycle_check(spark, sf_dir):
    """Three nations in a loop, and the suppliers that hang downstream of them."""
    edges = E.derive_edges(_nodes(spark, sf_dir)).select("source", "target")
    loop = spark.createDataFrame([("n0", "n1"), ("n1", "n2"), ("n2", "n0")], "source string, target string")
    return E.on_cycles(loop.unionByName(edges))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 3 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY sha256(text)")
def idempotent_dedupe(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return E.insert_if_absent(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0"), "sha", "doc_id").select("doc_id", "sha")


@query(
    """WITH o AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) AS orders FROM orders GROUP BY 1),
    l AS (SELECT o_custkey AS c_custkey, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT c_custkey, c_name AS name, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines, coalesce(orders, '') AS orders FROM customer LEFT JOIN o USING (c_custkey) LEFT JOIN l USING (c_custkey)"""
)
def report_nested(spark, sf_dir):
    """A report a customer: its orders as evidence, newest first, and their lines as artifacts."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("analysis_id"), X.html_escape(F.col("c_name")).alias("name"))
    evidence = o.select(F.col("o_custkey").alias("analysis_id"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("task"))
    artifacts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_linenumber").alias("artifact_id"))
    r = E.report(c, evidence, artifacts)
    told = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["evidence_id"].cast("string"), e["task"])), ",")
    n_lines = F.aggregate("evidence", F.lit(0).cast("long"), lambda s, e: s + F.size(e["artifacts"]))
    return r.select(F.col("analysis_id").alias("c_custkey"), "name", F.size("evidence").cast("long").alias("n_orders"), n_lines.alias("n_lines"), told.alias("orders"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar change, its mask, the mask's area, a recomputation of it, and an answer a tile."""
    f = _four(spark, sf_dir).withColumn("r", R.radar_change([(F.col("p1"), F.col("p2")), (F.col("q1"), F.col("q2"))], "db", 0.1))
    grid = F.struct(*(F.lit(v).alias(k) for k, v in zip("abcdef", (10.0, 0.0, 0.0, 0.0, -10.0, 100.0))))
    m = f.select("tile", F.col("r.mask").alias("mask"), R.count_true(F.col("r.mask")).alias("positives"), R.count_true(F.col("r.valid")).alias("valid"))
    m = m.withColumn("area", R.projected_area(F.col("positives"), grid, "ha"))
    again = F.aggregate("mask", F.lit(0.0), lambda s, x: s + F.when(x, 100.0 / 10_000).otherwise(0.0))
    checked = m.withColumn("verified", N.is_close(F.col("area"), again, 1e-9, 1e-9))
    answer = F.when(F.col("verified"), F.format_string("The changed area is %.2f ha.", "area")).otherwise("I cannot provide a verified answer because the evidence did not pass verification.")
    return checked.select("tile", "positives", "valid", N.micro(F.col("area")).alias("area_ha"), "verified", answer.alias("answer"))


QUERIES["change_area_answer"] = flagship
ORACLE_SQL["change_area_answer"] = f"""WITH {_FOUR}, s AS (SELECT tile, CASE WHEN p1 + p2 + q1 + q2 IS NOT NULL THEN greatest(abs(p2 - p1), abs(q2 - q1)) END AS s FROM f),
    k AS (SELECT tile, count(*) FILTER (s >= 0.1) AS p, count(s) AS v FROM s GROUP BY tile)
    SELECT CAST(tile AS BIGINT) AS tile, p AS positives, v AS valid, p * 10000 AS area_ha, true AS verified, printf('The changed area is %.2f ha.', p / 100.0) AS answer FROM k"""


@query(
    """WITH p AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS phrase, regexp_extract_all(lower(CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE p_type END), '[a-z0-9]+') AS class FROM part)
    SELECT p_partkey, len(class) > 0 AND len(list_filter(class, lambda w: NOT list_contains(phrase, w))) = 0 AS matches FROM p"""
)
def phrase_match(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", X.phrase_matches_class(F.col("p_name"), name).alias("matches"))


@query("SELECT 'S2_T' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || 'ABC_' || s_suppkey || '_7' AS patch, 'T' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || 'ABC_' || s_suppkey || '_7' AS cell FROM supplier")
def group_ids(spark, sf_dir):
    patch = F.concat(F.lit("S2_T"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit("ABC_"), F.col("s_suppkey").cast("string"), F.lit("_7"))
    return read(spark, sf_dir, "supplier").select(patch.alias("patch"), X.group_id(patch).alias("cell"))


@query("SELECT 'pair_' || substr(sha256(c_name || chr(0) || CAST(c_custkey AS VARCHAR)), 1, 24) AS sample, replace(replace(replace(c_name, '&', '&amp;'), '<', '&lt;'), '#', '#') AS label FROM customer")
def sample_ids(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(X.sample_id(F.col("c_name"), F.col("c_custkey").cast("string")).alias("sample"), X.html_escape(F.col("c_name")).alias("label"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS t FROM events")
def fixed_width_times(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", X.fixed_width_time(F.col("ts")).alias("t"))


@query(f"SELECT c_custkey, {_MICRO.format('(10.0 * (c_custkey % 50 - 7.5) - 2.0 * (c_nationkey - 3.25)) / 98.0')} AS col, {_MICRO.format('(10.0 * (c_nationkey - 3.25) - 1.0 * (c_custkey % 50 - 7.5)) / 98.0')} AS \"row\" FROM customer")
def world_to_pixel(spark, sf_dir):
    grid = F.struct(*(F.lit(v).alias(k) for k, v in zip("abcdef", (10.0, 2.0, 7.5, 1.0, 10.0, 3.25))))
    p = N.world_to_pixel(grid, F.col("c_custkey") % 50, F.col("c_nationkey").cast("double"), 0.0)
    return read(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", N.micro(F.col("p.col")).alias("col"), N.micro(F.col("p.row")).alias("row"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 = 0)")
def dangling_edges(spark, sf_dir):
    key = lambda c: F.col(c).cast("string")
    edges = read(spark, sf_dir, "supplier").select(key("s_nationkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("target"))
    nodes = read(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(key("n_nationkey").alias("evidence_id"))
    nodes = nodes.unionByName(edges.select(F.col("target").alias("evidence_id")))
    return E.dangling_edges(edges, nodes).select(F.substring("target", 2, 20).cast("long").alias("s_suppkey"), F.col("source").cast("int").alias("s_nationkey"))


@query("SELECT p_name, count(DISTINCT p_size) AS payloads FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def conflicting_duplicates(spark, sf_dir):
    return E.conflicting(read(spark, sf_dir, "part"), "p_name", "p_size")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf_dir):
    from .streaming.events import windowed_counts

    return windowed_counts(read(spark, sf_dir, "events"), "ts", "1 hour", "1 day", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_id > 500")
def stream_event_tail(spark, sf_dir):
    """The tail of the event table read as a stream: the same rows as the batch."""
    import uuid

    from .sources.shared import shared_folder
    from .streaming.events import event_stream, run_to_table, tail

    rows = event_stream(spark, sf_dir, read(spark, sf_dir, "events").schema, only="events.parquet").select("event_id", "user_id", F.col("event_id").alias("sequence"))
    folder = f"{shared_folder(spark)}/tail_{uuid.uuid4().hex}"
    return run_to_table(tail(rows, after=500), f"{folder}/rows", f"{folder}/checkpoint").select("event_id", "user_id")


@query(
    """WITH t AS (SELECT DISTINCT user_id FROM events WHERE event_id % 10 < 3), v AS (SELECT user_id, user_id IN (SELECT user_id FROM t) AS seen FROM events WHERE event_id % 10 >= 8 OR event_type = 'click')
    SELECT (SELECT count(*) FROM t) AS first_keys, count(DISTINCT user_id) AS second_keys, count(DISTINCT user_id) FILTER (seen) AS shared_keys, CAST(floor(avg(CAST(seen AS DOUBLE)) * 1e6 + 0.5) AS BIGINT) AS seen_share FROM v"""
)
def question_overlap(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    k = M.key_overlap(e.where("event_id % 10 < 3"), e.where("event_id % 10 >= 8 or event_type = 'click'"), "user_id")
    return k.withColumn("seen_share", N.micro(F.col("seen_share")))


@query(f"SELECT lang, {_MICRO.format('avg(CAST(quality = toxic AS DOUBLE))')} AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def exact_match_accuracy(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    return M.exact_match(d, "lang", F.col("quality"), F.col("toxic")).withColumn("accuracy", N.micro(F.col("accuracy")))


@query(
    f"""{_DECIDE}, f AS (SELECT lang, t, count(*) FILTER (score >= t AND target = 1) AS tp, count(*) FILTER (score >= t AND target <> 1) AS fp, count(*) FILTER (score < t AND target = 1) AS fn FROM d, (VALUES (CAST(0.3 AS DOUBLE)), (CAST(0.6 AS DOUBLE))) v(t) GROUP BY ALL),
    g AS (SELECT lang, t, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM f), j AS (SELECT a.lang, CAST(b.f1 AS DOUBLE) - CAST(a.f1 AS DOUBLE) AS delta FROM g a JOIN g b ON a.lang = b.lang AND a.t < 0.5 AND b.t > 0.5)
    SELECT lang, {_MICRO.format('delta')} AS delta, CASE WHEN delta > 0 THEN 'improved' WHEN delta < 0 THEN 'worse' ELSE 'equal' END AS change FROM j"""
)
def metric_deltas(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    scored = lambda t: M.confusion(d, ["lang"], threshold=t).select("lang", M.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
    return M.metric_deltas(scored(0.3), scored(0.6), "lang", "f1").select("lang", N.micro(F.col("delta")).alias("delta"), "change")


from . import graph_queries, raster_queries, record_queries, workflow_queries  # noqa: E402, F401  register their queries here
