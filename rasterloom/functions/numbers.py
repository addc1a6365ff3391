"""Numeric column functions: masking of non-finite values, tolerant comparison, ellipsoidal bands, boxes, affine grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semi-major axis in metres and inverse flattening by datum.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "NAD83": (6378137.0, 298.257222101)}
# Square metres in a unit.
AREA_UNITS = {"m2": 1.0, "ha": 10_000.0, "km2": 1_000_000.0}


def finite(x: Column) -> Column:
    """Null for NaN and the infinities, so that null is the one mark of a masked value."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def micro(x: Column) -> Column:
    """Millionths as a whole number, halves upwards."""
    return F.floor(x * 1e6 + 0.5).cast("long")


def is_close(a: Column, b: Column, rel: float = 1e-9, abs_: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where either is masked or the sum is zero."""
    return F.try_divide(finite(a) - finite(b), finite(a) + finite(b))


def log_ratio(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """|ln((b + eps) / (a + eps))|; null where either is masked or negative."""
    ok = (finite(a) >= 0) & (finite(b) >= 0)
    return F.when(ok, F.abs(F.ln((b + eps) / (a + eps))))


def stretch_to_byte(v: Column, lo: Column, hi: Column) -> Column:
    """Linear stretch of lo..hi to 0..255, clipped and truncated; 128 on an empty range, 0 where masked."""
    part = F.least(F.greatest((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * 255.0, F.lit(0.0)), F.lit(255.0))
    return F.when(v.isNull(), F.lit(0)).when(hi <= lo, F.lit(128)).otherwise(part.cast("int"))


def band_area(south: Column, north: Column, width_degrees: float, datum: str = "WGS84") -> Column:
    """Square metres of an ellipsoidal cell between two parallels, ``width_degrees`` wide; exact, no scale factor."""
    if datum not in ELLIPSOIDS:
        raise ValueError(f"no ellipsoid is known for datum {datum!r}")
    a, inverse = ELLIPSOIDS[datum]
    f = 1.0 / inverse
    e2 = f * (2.0 - f)
    e = math.sqrt(e2)

    def upto(phi: Column) -> Column:
        s = F.sin(F.radians(phi))
        return F.lit(a * a * (1.0 - e2)) * (s / (2.0 * (1.0 - e2 * s * s)) + F.atanh(s * e) / (2.0 * e))

    return F.lit(math.radians(width_degrees)) * (upto(north) - upto(south))


def box_area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def box_intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return w * h


def box_iou(a: Column, b: Column) -> Column:
    """0 where a box is missing or the union is empty."""
    both = box_intersection(a, b)
    return F.coalesce(F.try_divide(both, box_area(a) + box_area(b) - both), F.lit(0.0))


def overlap_fraction(a: Column, b: Column, least: Column | None = None) -> Column:
    """Intersection over the smaller area (``least``, where it is known), within 0..1; null if that area is not positive."""
    least = F.least(box_area(a), box_area(b)) if least is None else least
    return F.when(least > 0, F.least(F.greatest(box_intersection(a, b) / least, F.lit(0.0)), F.lit(1.0)))


def affine_determinant(t: Column) -> Column:
    return F.abs(t["a"] * t["e"] - t["b"] * t["d"])


def pixel_to_world(t: Column, col: Column, row: Column, offset: float = 0.5) -> Column:
    c, r = col + offset, row + offset
    return F.struct((t["a"] * c + t["b"] * r + t["c"]).alias("x"), (t["d"] * c + t["e"] * r + t["f"]).alias("y"))


def world_to_pixel(t: Column, x: Column, y: Column, offset: float = 0.5) -> Column:
    """Inverse of pixel_to_world; null for a singular transform."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    dx, dy = x - t["c"], y - t["f"]
    return F.when(det != 0, F.struct((F.try_divide(t["e"] * dx - t["b"] * dy, det) - offset).alias("col"), (F.try_divide(t["a"] * dy - t["d"] * dx, det) - offset).alias("row")))


def mercator_tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """Web-Mercator bounds in metres of a tile."""
    half = math.pi * 6378137.0
    size = F.lit(2 * half) / F.pow(F.lit(2.0), z)
    return F.struct((x * size - half).alias("left"), (half - (y + 1) * size).alias("bottom"), ((x + 1) * size - half).alias("right"), (half - y * size).alias("top"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)
