"""Display pyramids, and images in the size that a model takes. Rows stay tiles or images; nothing is exploded by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projections import through
from ..functions.records import fitted_size
from ..sources.shared import cut_lineage


def halved(data: Column, height: Column, width: Column) -> Column:
    """Means of the valid cells of 2 x 2 blocks, row-major; odd edges make blocks of fewer cells, a block without valid cells is null."""
    return through(data, lambda d: _means(d, height, width))


def _means(data: Column, height: Column, width: Column) -> Column:
    wide = F.ceil(width / 2).cast("int")
    n = (F.ceil(height / 2) * wide).cast("int")

    def mean(i: Column) -> Column:
        r, c = F.floor(i / wide).cast("int") * 2, (i % wide) * 2
        cell = lambda y, x: F.when((r + y < height) & (c + x < width), F.get(data, (r + y) * width + c + x))
        four = F.filter(F.array(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1)), lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(four, F.lit(0.0), lambda s, v: s + v), F.size(four))

    return F.transform(F.sequence(F.lit(0), n - 1), mean)


def _covered(there: Column, height: Column, width: Column) -> Column:
    """Whether each 2 x 2 block holds a cell of the raster; ``there`` null: all cells are of it."""
    known = halved(F.transform(there, lambda t: F.when(t, 1.0)), height, width)
    every = F.array_repeat(F.lit(True), (F.ceil(height / 2) * F.ceil(width / 2)).cast("int"))
    return F.when(there.isNull(), every).otherwise(F.transform(known, lambda v: v.isNotNull()))


def _joined(side: int, cells: str, null: Column) -> Column:
    """The ``cells`` of up to four quarters (at, height, width, ``cells``) of a tile, row by row; ``null`` is what a missing quarter covers."""
    quarter = lambda k: F.get(F.filter("quarters", lambda q: q["at"] == k), F.lit(0))

    def row(r: Column) -> Column:
        below = r >= side
        left, right = F.when(below, quarter(2)).otherwise(quarter(0)), F.when(below, quarter(3)).otherwise(quarter(1))
        at = F.when(below, r - side).otherwise(r)
        part = lambda q, width: F.when(q.isNull() | (at >= q["height"]), F.transform(F.sequence(F.lit(1), width), lambda i: null)).otherwise(F.slice(q[cells], at * q["width"] + 1, q["width"]))
        own = F.least(F.col("width"), F.lit(side))
        return F.when(F.col("width") > side, F.concat(part(left, own), part(right, F.col("width") - side))).otherwise(part(left, own))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.col("height") - 1), row))


def levels(tiles: DataFrame, keys: list[str], side: int, most: int, cap: int = 24) -> DataFrame:
    """level, ``keys``, tile_row, tile_col, height, width, data, there, alpha: the raster and its overviews.

    tiles: ``keys``, tile_row, tile_col, height, width, data, cut every ``side`` cells (an even number). Each level is
    made of 2 x 2 means of valid cells of the level below, until both sides of every raster are within ``most`` cells
    or ``cap`` levels are made. A tile halves its own cells, and four halves become a tile: each level moves a quarter
    of the cells of the one below, by tile. alpha: 255 where a cell is valid, else 0. there: null, or, in a tile over
    missing ones, whether each cell covers a cell of the raster at all.
    """
    if side % 2 or most < 1:
        raise ValueError("an even tile size and a size of at least 1 are needed")
    half = side // 2
    base = cut_lineage(tiles.select(F.lit(0).alias("level"), *keys, "tile_row", "tile_col", "height", "width", "data", F.lit(None).cast("array<boolean>").alias("there")))
    made, now = base, base
    for level in range(1, cap + 1):
        size = now.groupBy(*keys).agg(F.max(F.col("tile_row") * side + F.col("height")).alias("h"), F.max(F.col("tile_col") * side + F.col("width")).alias("w"))
        large = size.where(F.greatest("h", "w") > most).select(*keys, F.ceil(F.col("h") / 2).cast("int").alias("h"), F.ceil(F.col("w") / 2).cast("int").alias("w"))
        large = cut_lineage(large)
        if large.isEmpty():
            break
        small = now.select(*keys, F.expr("tile_row div 2").cast("int").alias("tile_row"), F.expr("tile_col div 2").cast("int").alias("tile_col"), F.struct(((F.col("tile_row") % 2) * 2 + F.col("tile_col") % 2).cast("int").alias("at"), F.ceil(F.col("height") / 2).cast("int").alias("height"), F.ceil(F.col("width") / 2).cast("int").alias("width"), halved(F.col("data"), F.col("height"), F.col("width")).alias("data"), _covered(F.col("there"), F.col("height"), F.col("width")).alias("there")).alias("q"))
        whole = small.join(large, keys).groupBy(*keys, "tile_row", "tile_col", "h", "w").agg(F.collect_list("q").alias("quarters"))
        within = lambda k, i: F.least(F.lit(side), F.col(k) - F.col(i) * side).cast("int")
        sized = whole.withColumns({"height": within("h", "tile_row"), "width": within("w", "tile_col")})
        data, there = _joined(half, "data", F.lit(None).cast("double")), _joined(half, "there", F.lit(False))
        there = through(there, lambda t: F.when(F.exists(t, lambda x: ~x), t))
        now = cut_lineage(sized.select(F.lit(level).alias("level"), *keys, "tile_row", "tile_col", "height", "width", data.alias("data"), there.alias("there")))
        made = made.union(now)
    return made.withColumn("alpha", F.transform("data", lambda v: F.when(v.isNull(), 0).otherwise(255)))


def _weights(i: Column, size: Column, out: Column) -> Column:
    """(from, weights): the cells of a line that make cell ``i`` of a resized one: a triangle, as wide as the scale where cells are merged."""
    scale = size / out
    reach, centre = F.greatest(scale, F.lit(1.0)), (i + 0.5) * scale
    first = F.greatest(F.floor(centre - reach), F.lit(0)).cast("int")
    last = F.least(F.ceil(centre + reach), size).cast("int") - 1
    return F.struct(first.alias("first"), F.transform(F.sequence(first, last), lambda j: F.greatest(F.lit(0.0), 1.0 - F.abs(j + 0.5 - centre) / reach)).alias("weights"))


def _line(n: Column, tap: Column, cell) -> Column:
    """struct(v, k): sums of values and of supports (each times a weight) over the cells of a line that have support."""
    both = F.transform(tap["weights"], lambda w, k: F.struct(cell(n, tap["first"] + k).alias("c"), w.alias("w")))
    kept = F.filter(both, lambda x: x["c"].isNotNull())
    return F.struct(*(F.aggregate(F.transform(kept, lambda x: x["c"][k] * x["w"]), F.lit(0.0), lambda s, x: s + x).alias(k) for k in ("v", "k")))


def fit_and_pad(images: DataFrame, most_width: int, most_height: int, padding: tuple[int, int, int]) -> DataFrame:
    """``images`` with ``input``: three arrays of bytes of most_width x most_height, the fitted image in the middle of the padding.

    images: width, height, colours (one or three arrays of doubles, row-major; one is taken for all three) and alpha
    (an array, 0 where there is nothing to show). Colours are resized along rows, then along columns, each by weights of
    one line (``_weights``): both passes carry the weights of the cells that have an alpha along, and divide at the end; alpha takes the nearest cell. Where it is 0, and where no
    cell supports a colour, the padding shows. Bytes are rounded, halves upwards.
    """
    size = fitted_size(F.col("width").cast("double"), F.col("height").cast("double"), most_width, most_height)
    width, height, w, h = F.col("width"), F.col("height"), F.col("_s.width"), F.col("_s.height")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    taps = F.struct(F.transform(span(w), lambda i: _weights(i, width, w)).alias("across"), F.transform(span(h), lambda i: _weights(i, height, h)).alias("down"), F.col("colours").alias("colours"), F.col("alpha").alias("alpha"))
    nearest = lambda i, n, out: F.least(F.floor((i + 0.5) * n / out), n - 1).cast("int")
    top, left = F.floor((F.lit(most_height) - h) / 2).cast("int"), F.floor((F.lit(most_width) - w) / 2).cast("int")

    # What a lambda names is bound first: an expression in its place would be computed anew for each cell.
    def resized(t: Column, band: Column) -> Column:
        value = lambda i: F.when((F.get(t["alpha"], i) != 0) & F.get(band, i).isNotNull(), F.struct(F.get(band, i).cast("double").alias("v"), F.lit(1.0).alias("k")))
        source = lambda r, c: value(r * width + c)
        rows = F.transform(span(height), lambda r: F.transform(t["across"], lambda x: _line(r, x, source)))
        return through(rows, lambda lines: F.transform(t["down"], lambda y: F.transform(span(w), lambda c: _line(c, y, lambda c, r: F.get(F.get(lines, r), c)))))

    def padded(t: Column, bands: Column, k: int) -> Column:
        def cell(lines: Column, i: Column) -> Column:
            r, c = F.floor(i / most_width).cast("int") - top, (i % most_width).cast("int") - left
            shown = (r >= 0) & (c >= 0) & (r < h) & (c < w) & (F.get(t["alpha"], nearest(r, height, h) * width + nearest(c, width, w)) != 0)
            value = F.floor(F.try_divide(F.get(F.get(lines, r), c)["v"], F.get(F.get(lines, r), c)["k"]) + 0.5)
            return F.coalesce(F.when(shown & value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), value))), F.lit(padding[k])).cast("int")

        return through(F.coalesce(F.get(bands, F.lit(k)), F.get(bands, F.lit(0))), lambda lines: F.transform(F.sequence(F.lit(0), F.lit(most_width * most_height - 1)), lambda i: cell(lines, i)))

    made = through(taps, lambda t: through(F.transform(t["colours"], lambda b: resized(t, b)), lambda bands: F.array(*(padded(t, bands, k) for k in range(3)))))
    return images.withColumn("_s", size).select(*(F.col(f"`{c}`") for c in images.columns), made.alias("input"))
