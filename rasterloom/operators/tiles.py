"""XYZ map tiles of rasters: colours bilinear and opacity nearest through the warp, masks by a registered colour map.

Rasters stay tile rows: a map tile meets only the raster tiles that its places need (``warp``). A raster without a
coordinate system is shown on its own cells: at level z it is cut in 2^z x 2^z equal parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import records as C
from ..sources.geotiff import png
from .warp import warp

#: Cells along an edge of a map tile, and the deepest level.
SIZE = 256
DEEPEST = 24
#: Codes of Web Mercator, and of a raster's own cells.
MERCATOR = 3857
CELLS = 0


def _grid(a, b, c, d, e, f, width, height, crs) -> Column:
    return F.struct(*(x.cast("double").alias(k) for k, x in zip("abcdef", (a, b, c, d, e, f))), width.cast("int").alias("width"), height.cast("int").alias("height"), crs.cast("int").alias("crs"))


def _asked(requests: DataFrame, size: int, deepest: int) -> DataFrame:
    """``requests`` within their level's grid, with source and target grids; others have no tile."""
    zero, one, n = F.lit(0.0), F.lit(1.0), F.lit(size)
    asked = requests.where(C.tile_in_domain(F.col("z"), F.col("x"), F.col("y"), deepest))
    s, b = F.col("source"), N.mercator_tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    side = F.pow(F.lit(2.0), F.col("z"))
    located = _grid((b["right"] - b["left"]) / size, zero, b["left"], zero, (b["bottom"] - b["top"]) / size, b["top"], n, n, F.lit(MERCATOR))
    part = _grid(s["width"] / side / size, zero, F.col("x") * s["width"] / side, zero, s["height"] / side / size, F.col("y") * s["height"] / side, n, n, F.lit(CELLS))
    own = _grid(one, zero, zero, zero, one, zero, s["width"], s["height"], F.lit(CELLS))
    on_map = s["crs"].isNotNull()
    return asked.select("pair", "observation", F.when(on_map, F.struct(*(s[k].alias(k) for k in (*"abcdef", "width", "height", "crs")))).otherwise(own).alias("source"), F.when(on_map, located).otherwise(part).alias("target"))


def _bytes(data: Column) -> Column:
    """0 to 255, rounded; 0 where nothing is shown."""
    return F.transform(data, lambda v: F.least(F.greatest(F.floor(F.coalesce(v, F.lit(0.0)) + 0.5), F.lit(0)), F.lit(255)).cast("int"))


def render(rasters: DataFrame, requests: DataFrame, side: int, colours: tuple[int, ...], alpha: int, size: int = SIZE, deepest: int = DEEPEST) -> DataFrame:
    """(pair, red, green, blue, alpha): arrays of size x size bytes, row-major, a row a request within its level.

    rasters: observation, band, tile_row, tile_col, height, width, data (0 to 255, null where nothing is), cut every
    ``side`` cells; requests: pair (unique), observation, source (a grid, see ``warp.places``; crs null: none), z, x, y.
    One colour band is grey, three are red, green and blue; ``alpha`` is the band of opacity."""
    if len(colours) not in (1, 3):
        raise ValueError("a tile has one colour band or three")
    asked = _asked(requests, size, deepest)
    shown = warp(rasters.where(F.col("band").isin(*colours)), asked, side, "bilinear", out_side=size)
    solid = warp(rasters.where(F.col("band") == alpha), asked, side, "nearest", out_side=size)
    named = zip(("red", "green", "blue"), colours if len(colours) == 3 else colours * 3)
    bands = shown.groupBy("pair").agg(*(F.max(F.when(F.col("band") == b, _bytes(F.col("data")))).alias(name) for name, b in named))
    return bands.join(solid.select("pair", _bytes(F.col("data")).alias("alpha")), "pair")


def render_mask(masks: DataFrame, requests: DataFrame, side: int, colourmap: dict[int, tuple[int, int, int, int]], size: int = SIZE, deepest: int = DEEPEST) -> DataFrame:
    """(pair, red, green, blue, alpha) of masks of one band: nearest values through ``colourmap``; other values are transparent."""
    found = warp(masks, _asked(requests, size, deepest), side, "nearest", out_side=size)
    table = F.create_map(*(x for value, colour in colourmap.items() for x in (F.lit(value), F.array(*map(F.lit, colour)))))
    blank = F.array(*[F.lit(0)] * 4)
    rgba = F.transform(_bytes(F.col("data")), lambda v: F.coalesce(F.try_element_at(table, v), blank))
    channel = lambda i: F.transform("_rgba", lambda c: F.get(c, F.lit(i)))
    return found.select("pair", rgba.alias("_rgba")).select("pair", *(channel(i).alias(name) for i, name in enumerate(("red", "green", "blue", "alpha"))))


def encoded(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """(pair, png): rendered tiles as PNG files, one Arrow batch at a time."""

    def run(batches):
        for b in batches:
            bands = [b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size) for k in ("red", "green", "blue", "alpha")]
            yield pa.RecordBatch.from_arrays([b.column("pair"), pa.array([png(x) for x in np.stack(bands, axis=3)], pa.binary())], ["pair", "png"])

    pair = tiles.schema["pair"].dataType.simpleString()
    return tiles.select("pair", "red", "green", "blue", "alpha").mapInArrow(run, f"pair {pair}, png binary")
