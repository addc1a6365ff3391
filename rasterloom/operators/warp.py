"""Tiles of a raster on another grid: another resolution, rotation or coordinate system. Rows stay tiles throughout.

1. Halo: each tile sends its first column, first row and first cell to the tiles left of, above and diagonal to it, so
   that the four cells around any place inside a tile are in one row.
2. Target tiles are made from the grids alone. The places of a tile's cells in the source grid tell which source tiles
   it needs; it meets just these.
3. Each meeting yields an array of the target tile's cells, null where another source tile holds the place; the arrays
   of a target tile are merged.

A tile's cells stay in its row: the halo moves each source tile once, with thin slices of its neighbours, and a source
tile moves once more for each target tile that needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import projections as J

METHODS = ("nearest", "bilinear")


def with_halo(tiles: DataFrame, keys: list[str], side: int) -> DataFrame:
    """``keys``, tile_row, tile_col, height, width and ``haloed``: (height + 1) x (width + 1) cells, the last row and column from the tiles below and right; null where there is none.

    tiles: ``keys``, tile_row, tile_col, height, width, data (row-major), cut every ``side`` cells. A missing tile left
    of, above or diagonal to another one is there too, all masked: places in its last row or column have support beyond it."""
    w, h = F.col("width"), F.col("height")
    none = F.lit(None).cast(tiles.schema["data"].dataType)
    column = F.transform(F.sequence(F.lit(0), h - 1), lambda r: F.get("data", r * w))
    part = lambda up, left, **held: F.struct((F.col("tile_row") - up).alias("tile_row"), (F.col("tile_col") - left).alias("tile_col"), *(held.get(k, none).alias(k) for k in ("data", "right", "below", "corner")))
    sent = F.array(part(0, 0, data=F.col("data")), part(0, 1, right=column), part(1, 0, below=F.slice("data", 1, w)), part(1, 1, corner=F.slice("data", 1, 1)))
    got = tiles.select(*keys, "height", "width", F.explode(sent).alias("s")).select(*keys, "s.*", "height", "width").where("tile_row >= 0 and tile_col >= 0")
    kept = lambda c: F.first(c, ignorenulls=True).alias(c)
    # A tile is as high as the one right of it and as wide as the one below; before others it is whole.
    size = lambda c, beside: F.coalesce(F.max(F.when(F.col("data").isNotNull(), F.col(c))), F.max(F.when(F.col(beside).isNotNull(), F.col(c))), F.lit(side)).alias(c)
    met = got.groupBy(*keys, "tile_row", "tile_col").agg(size("height", "right"), size("width", "below"), *map(kept, ("data", "right", "below", "corner")))
    met = met.withColumn("data", F.coalesce("data", F.array_repeat(F.lit(None).cast("double"), h * w)))
    rows = F.transform(F.sequence(F.lit(0), h - 1), lambda r: F.concat(F.slice("data", r * w + 1, w), F.array(F.get("right", r))))
    empty = F.transform(F.sequence(F.lit(1), w), lambda i: F.lit(None).cast("double"))
    last = F.concat(F.when(F.col("below").isNull(), empty).otherwise(F.slice(F.concat("below", empty), 1, w)), F.array(F.get("corner", F.lit(0))))
    return met.select(*keys, "tile_row", "tile_col", "height", "width", F.concat(F.flatten(rows), last).alias("haloed"))


def places(target: Column, source: Column, row: Column, col: Column, height: Column, width: Column) -> Column:
    """For the cells of a window of the target grid (row-major): struct(row, col) in the source grid, in cell centres; null outside it.

    A grid is a struct of a, b, c, d, e, f (affine, to the cell's corner), width, height and crs (a code)."""

    def at(i: Column) -> Column:
        p = N.pixel_to_world(target, col + i % width, row + F.floor(i / width))
        q = J.through(p, lambda p: J.convert(p["x"], p["y"], target["crs"], source["crs"]))
        s = J.through(q, lambda q: N.world_to_pixel(source, q["x"], q["y"]))
        inside = lambda s: (s["row"] >= -0.5) & (s["row"] <= source["height"] - 0.5) & (s["col"] >= -0.5) & (s["col"] <= source["width"] - 0.5)
        return J.through(s, lambda s: F.when(inside(s), s))

    return F.transform(F.sequence(F.lit(0), (height * width - 1).cast("int")), at)


def _base(x: Column, most: Column) -> Column:
    """The first of the two cells around a place, within the raster."""
    return F.least(F.greatest(F.floor(x), F.lit(0)), most - 1).cast("int")


def _value(method: str, p: Column) -> Column:
    """The value at a place, from the haloed tile of its row; null outside the tile, or where no valid cell supports it."""
    r, c = _base(p["row"], F.col("source.height")), _base(p["col"], F.col("source.width"))
    near_r, near_c = (F.least(F.floor(p[k] + 0.5), F.col("source")[side] - 1).cast("int") for k, side in (("row", "height"), ("col", "width")))
    r, c = (r, c) if method == "bilinear" else (F.greatest(near_r, F.lit(0)), F.greatest(near_c, F.lit(0)))
    top, left, h, w = F.col("tile_row") * F.col("side"), F.col("tile_col") * F.col("side"), F.col("height"), F.col("width")
    here = p.isNotNull() & (r >= top) & (r < top + h) & (c >= left) & (c < left + w)
    cell = lambda i, j: F.get("haloed", (r - top + i) * (w + 1) + (c - left + j))
    if method == "nearest":
        return F.when(here, cell(0, 0))
    # Places before the first or beyond the last centre have one supporting row or column.
    fr, fc = F.least(F.greatest(p["row"] - r, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(p["col"] - c, F.lit(0.0)), F.lit(1.0))
    taps = [(cell(i, j), (fr if i else 1 - fr) * (fc if j else 1 - fc)) for i in (0, 1) for j in (0, 1)]
    total = sum((F.when(v.isNotNull(), v * g).otherwise(0.0) for v, g in taps[1:]), F.when(taps[0][0].isNotNull(), taps[0][0] * taps[0][1]).otherwise(0.0))
    weight = sum((F.when(v.isNotNull(), g).otherwise(0.0) for v, g in taps[1:]), F.when(taps[0][0].isNotNull(), taps[0][1]).otherwise(0.0))
    return F.when(here & (weight > 0), total / weight)


def warp(tiles: DataFrame, pairs: DataFrame, side: int, method: str = "bilinear", out_side: int | None = None) -> DataFrame:
    """Tiles of ``tiles`` on other grids: pair, band, tile_row, tile_col, height, width, data, valid.

    tiles: observation, band, tile_row, tile_col, height, width, data (doubles, null where masked), cut every ``side`` cells;
    pairs: pair, observation, source and target (grids, see ``places``); both grids must have an area (determinant).
    Bilinear takes the four cells around, weighs the valid ones and divides by their weights; nearest takes one. valid
    tells the cells that all bands of the observation support; data of a band are null where that band has no support.
    """
    if method not in METHODS:
        raise ValueError(f"unknown resampling {method!r}")
    out = out_side or side
    count = lambda c: F.ceil(F.col("target")[c] / out).cast("int") - 1
    wanted = pairs.where((N.affine_determinant(F.col("source")) > 0) & (N.affine_determinant(F.col("target")) > 0))
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(0), count("height"))).alias("out_row")).select("*", F.explode(F.sequence(F.lit(0), count("width"))).alias("out_col"))
    size = lambda i, c: F.least(F.lit(out), F.col("target")[c] - F.col(i) * out).cast("int")
    wanted = wanted.select("*", size("out_row", "height").alias("out_height"), size("out_col", "width").alias("out_width"))
    where = places(F.col("target"), F.col("source"), F.col("out_row") * out, F.col("out_col") * out, F.col("out_height"), F.col("out_width"))
    # The tile of the nearest cell or of the first of the four; either is within half a cell of the place.
    reach = lambda p, i: F.struct(*(F.floor(_base(p[k] + (0.5 if method == "nearest" else 0.0), F.col("source")[s]) / side).cast("int").alias(n) for k, s, n in (("row", "height", "tile_row"), ("col", "width", "tile_col"))))
    wanted = wanted.withColumn("places", where)
    needs = F.array_distinct(F.transform(F.filter("places", lambda p: p.isNotNull()), lambda p: reach(p, 0)))
    asked = wanted.select("*", F.explode(needs).alias("t")).select("pair", "observation", "source", "places", "out_row", "out_col", "t.tile_row", "t.tile_col")
    met = asked.join(with_halo(tiles, ["observation", "band"], side), ["observation", "tile_row", "tile_col"]).withColumn("side", F.lit(side))
    found = met.select("pair", "band", "out_row", "out_col", F.transform("places", lambda p: _value(method, p)).alias("part"))
    merged = F.reduce(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.get("parts", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, y)))
    bands = found.groupBy("pair", "band", "out_row", "out_col").agg(F.collect_list("part").alias("parts")).select("pair", "band", "out_row", "out_col", merged.alias("data"))
    # Target tiles that no source tile reaches are there too, with all cells masked.
    all_bands = pairs.join(tiles.select("observation", "band").distinct(), "observation").select("pair", "band")
    blank = F.transform(F.sequence(F.lit(1), F.col("out_height") * F.col("out_width")), lambda i: F.lit(None).cast("double"))
    every = wanted.select("pair", "out_row", "out_col", "out_height", "out_width").join(all_bands, "pair").join(bands, ["pair", "band", "out_row", "out_col"], "left").withColumn("data", F.coalesce("data", blank))
    stacked = every.groupBy("pair", "out_row", "out_col", "out_height", "out_width").agg(F.collect_list(F.struct("band", "data")).alias("bands"))
    held = F.transform(F.sequence(F.lit(0), F.col("out_height") * F.col("out_width") - 1), lambda i: F.forall("bands", lambda b: F.get(b["data"], i).isNotNull()))
    told = stacked.withColumn("valid", held).select("pair", "out_row", "out_col", "out_height", "out_width", "valid", F.explode("bands").alias("b"))
    return told.select("pair", "b.band", F.col("out_row").alias("tile_row"), F.col("out_col").alias("tile_col"), F.col("out_height").alias("height"), F.col("out_width").alias("width"), "b.data", "valid")
