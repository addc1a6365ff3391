"""Raster operators over tile rows: arrays of values with null for masked cells.

A tile row holds a band's values of one tile in row-major order, so that every pixel-wise operator is a projection
over one joined row: the only shuffle is the join of two observations' tiles on their keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers as N

# The two band roles of each index.
INDEX_BANDS = {"ndvi": ("nir", "red"), "ndwi": ("green", "nir"), "mndwi": ("green", "swir1")}
DIRECTIONS = ("absolute", "increase", "decrease")
DOMAINS = ("db", "linear_power")


def masked(data: Column, valid: Column) -> Column:
    """Values with null where they are not valid or not finite; null if the lengths differ."""
    return F.when(F.size(data) == F.size(valid), F.zip_with(data, valid, lambda d, v: F.when(v, N.finite(d))))


def spectral_index(name: str, bands: dict[str, Column]) -> Column:
    if name not in INDEX_BANDS:
        raise ValueError(f"unknown index {name!r}")
    missing = [b for b in INDEX_BANDS[name] if b not in bands]
    if missing:
        raise ValueError(f"{name} needs the bands {missing}")
    a, b = (bands[k] for k in INDEX_BANDS[name])
    return F.zip_with(a, b, N.normalized_difference)


def temporal_difference(first: Column, second: Column) -> Column:
    return F.zip_with(first, second, lambda a, b: N.finite(b) - N.finite(a))


def threshold_mask(difference: Column, threshold: float, direction: str) -> Column:
    """Inclusive threshold; masked cells are false."""
    if direction not in DIRECTIONS or not 0 <= threshold < float("inf"):
        raise ValueError("a known direction and a finite threshold of 0 or more are needed")
    side = {"absolute": lambda d: F.abs(d), "increase": lambda d: d, "decrease": lambda d: -d}[direction]
    return F.transform(difference, lambda d: F.coalesce(side(d) >= threshold, F.lit(False)))


def radar_change(pairs: list[tuple[Column, Column]], domain: str, threshold: float) -> Column:
    """struct(score, valid, mask) of arrays over polarisations of two times.

    A cell is valid if all polarisations are; its score is the greatest change, and 0 where it is not valid.
    """
    if domain not in DOMAINS:
        raise ValueError(f"unknown radiometric domain {domain!r}")
    change = (lambda a, b: F.abs(N.finite(b) - N.finite(a))) if domain == "db" else (lambda a, b: N.log_ratio(a, b))
    each = [F.zip_with(a, b, change) for a, b in pairs]
    score = each[0]
    for x in each[1:]:
        score = F.zip_with(score, x, lambda p, q: F.when(p.isNotNull() & q.isNotNull(), F.greatest(p, q)))
    return F.struct(
        F.transform(score, lambda s: F.coalesce(s, F.lit(0.0))).alias("score"),
        F.transform(score, lambda s: s.isNotNull()).alias("valid"),
        F.transform(score, lambda s: F.coalesce(s >= threshold, F.lit(False))).alias("mask"),
    )


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda x: x)).cast("long")


def mask_agreement(a: Column, b: Column, valid: Column) -> Column:
    """struct(intersection, union, valid, iou) over valid cells; iou is null on an empty union."""
    cells = F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), valid, lambda c, v: F.when(v, c))
    both = F.size(F.filter(cells, lambda c: F.coalesce(c["a"] & c["b"], F.lit(False)))).cast("long")
    either = F.size(F.filter(cells, lambda c: F.coalesce(c["a"] | c["b"], F.lit(False)))).cast("long")
    return F.struct(both.alias("intersection"), either.alias("union"), count_true(valid).alias("valid"), F.try_divide(both, either).alias("iou"))


def projected_area(positives: Column, transform: Column, unit: str = "m2", metres_per_unit: float = 1.0) -> Column:
    if unit not in N.AREA_UNITS:
        raise ValueError(f"unknown area unit {unit!r}")
    return positives * N.affine_determinant(transform) * (metres_per_unit**2) / N.AREA_UNITS[unit]


def ellipsoidal_area(mask: Column, width: int, north: Column, cell_degrees: float, unit: str = "m2", datum: str = "WGS84") -> Column:
    """Area of a north-up geographic mask: each row of cells by the exact area of its band."""
    rows = F.sequence(F.lit(0), F.floor(F.size(mask) / width).cast("int") - 1)

    def row_area(r):
        top = north - r * cell_degrees
        n = F.size(F.filter(F.slice(mask, r * width + 1, F.lit(width)), lambda x: x))
        return n * N.band_area(top - cell_degrees, top, cell_degrees, datum)

    return F.aggregate(F.transform(rows, row_area), F.lit(0.0), lambda s, x: s + x) / N.AREA_UNITS[unit]
