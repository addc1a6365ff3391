"""Map projections as column expressions: longitude and latitude, Web Mercator and UTM, both ways, and bounds between them.

A coordinate system is a column of codes: 4326 (degrees, x east), 3857, 32601 to 32660 and 32701 to 32760. Transverse
Mercator is the series of sixth order in the third flattening (errors far below a micrometre within a zone and some
10 degrees around it); latitudes come from conformal ones by a fixed number of contractions of e^2 each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import ELLIPSOIDS

_A, _INVERSE = ELLIPSOIDS["WGS84"]
_FLAT = 1.0 / _INVERSE
_E = math.sqrt(_FLAT * (2.0 - _FLAT))
_N = _FLAT / (2.0 - _FLAT)
# Coefficients of the published series, by harmonic, of the powers of n from the harmonic's number on.
_FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
_BACKWARD = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# UTM's scale on the central meridian, false easting and (south) false northing.
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0
#: Northing of the pole, north zones.
POLE = SCALE * _RADIUS * math.pi / 2
_CONTRACTIONS = 8
#: Points between the corners of an edge.
DENSIFY = 21


def _sum(table: tuple[tuple[float, ...], ...]) -> list[float]:
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(table, 1)]


ALPHA, BETA = _sum(_FORWARD), _sum(_BACKWARD)


def is_north(crs: Column) -> Column:
    return crs.between(32601, 32660)


def is_utm(crs: Column) -> Column:
    return is_north(crs) | crs.between(32701, 32760)


def known(crs: Column) -> Column:
    return crs.isin(4326, 3857) | is_utm(crs)


def code(text: Column) -> Column:
    """The number of 'EPSG:n' if that system is known, else null."""
    found = F.regexp_extract(F.upper(F.trim(text)), r"^EPSG:(\d{4,5})$", 1)
    number = F.when(found != "", found).cast("int")
    return F.when(known(number), number)


def _meridian(crs: Column) -> Column:
    return (crs % 100) * 6.0 - 183.0


def through(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _point(x: Column, y: Column) -> Column:
    ok = F.abs(x + y) < F.lit(float("inf"))
    return F.when(ok, F.struct(x.alias("x"), y.alias("y")))


def _sin_to_latitude(psi: Column) -> Column:
    """Degrees of latitude of an isometric latitude."""
    s = F.tanh(psi)
    for _ in range(_CONTRACTIONS):
        s = F.tanh(psi + F.lit(_E) * F.atanh(s * _E))
    return F.degrees(F.atan(F.sinh(psi + F.lit(_E) * F.atanh(s * _E))))


def _isometric(latitude: Column) -> Column:
    s = F.sin(F.radians(latitude))
    return F.atanh(s) - F.lit(_E) * F.atanh(s * _E)


def wrapped(degrees: Column) -> Column:
    """Within -180 (included) and 180."""
    return degrees - F.floor((degrees + 180.0) / 360.0) * 360.0


def _forward(longitude: Column, latitude: Column, crs: Column) -> Column:
    """UTM of degrees; each step is bound before the next one names it."""
    start = F.struct(F.sinh(_isometric(latitude)).alias("t"), F.radians(wrapped(longitude - _meridian(crs))).alias("d"))
    turned = lambda s: F.struct(F.atan2(s["t"], F.cos(s["d"])).alias("xi"), F.asinh(F.sin(s["d"]) / F.sqrt(s["t"] * s["t"] + F.cos(s["d"]) * F.cos(s["d"]))).alias("eta"))

    def placed(s: Column) -> Column:
        north, east = s["xi"], s["eta"]
        for j, a in enumerate(ALPHA, 1):
            north = north + F.lit(a) * F.sin(s["xi"] * (2 * j)) * F.cosh(s["eta"] * (2 * j))
            east = east + F.lit(a) * F.cos(s["xi"] * (2 * j)) * F.sinh(s["eta"] * (2 * j))
        return F.struct((F.lit(EAST) + east * (SCALE * _RADIUS)).alias("x"), (F.when(is_north(crs), 0.0).otherwise(SOUTH) + north * (SCALE * _RADIUS)).alias("y"))

    return through(through(through(start, turned), placed), lambda p: _point(p["x"], p["y"]))


def _backward(x: Column, y: Column, crs: Column) -> Column:
    start = F.struct(((y - F.when(is_north(crs), 0.0).otherwise(SOUTH)) / (SCALE * _RADIUS)).alias("xi"), ((x - EAST) / (SCALE * _RADIUS)).alias("eta"))

    def turned(s: Column) -> Column:
        north, east = s["xi"], s["eta"]
        for j, b in enumerate(BETA, 1):
            north = north - F.lit(b) * F.sin(s["xi"] * (2 * j)) * F.cosh(s["eta"] * (2 * j))
            east = east - F.lit(b) * F.cos(s["xi"] * (2 * j)) * F.sinh(s["eta"] * (2 * j))
        return F.struct(north.alias("n"), east.alias("e"))

    placed = lambda s: F.struct(wrapped(_meridian(crs) + F.degrees(F.atan2(F.sinh(s["e"]), F.cos(s["n"])))).alias("x"), F.atanh(F.sin(s["n"]) / F.cosh(s["e"])).alias("psi"))
    return through(through(through(start, turned), placed), lambda s: through(F.struct(s["x"].alias("x"), _sin_to_latitude(s["psi"]).alias("y")), lambda p: _point(p["x"], p["y"])))


def from_degrees(longitude: Column, latitude: Column, crs: Column) -> Column:
    """struct(x, y) in a system; null where it is unknown, beyond the poles or not finite."""
    mercator = _point(F.radians(longitude) * _A, F.asinh(F.tan(F.radians(latitude))) * _A)
    inside = F.abs(latitude) < 90.0
    return F.when(crs == 4326, F.when(F.abs(latitude) <= 90.0, _point(longitude, latitude))).when(~inside, None).when(crs == 3857, mercator).when(is_utm(crs), _forward(longitude, latitude, crs))


def to_degrees(x: Column, y: Column, crs: Column) -> Column:
    """struct(x, y): longitude and latitude; null where the system is unknown or the place is no place of it."""
    mercator = _point(F.degrees(x / _A), F.degrees(F.atan(F.sinh(y / _A))))
    return F.when(crs == 4326, F.when(F.abs(y) <= 90.0, _point(x, y))).when(crs == 3857, mercator).when(is_utm(crs), _backward(x, y, crs))


def convert(x: Column, y: Column, source: Column, target: Column) -> Column:
    """struct(x, y) of a place of one system in another one."""
    return F.when(source == target, _point(x, y)).otherwise(through(to_degrees(x, y, source), lambda p: from_degrees(p["x"], p["y"], target)))


def transform_bounds(box: Column, source: Column, target: Column, densify: int = DENSIFY) -> Column:
    """Bounds struct(x1, y1, x2, y2) of a box of one system in another one, over edges with ``densify`` points between corners.

    Degrees: x1 > x2 tells that the box runs over the antimeridian; a box around a pole holds all longitudes and ends at
    the pole. Null for an unknown system, a box that is no box, or a place that the target does not have.
    """
    if densify < 0:
        raise ValueError("densify must not be negative")
    n = densify + 1
    part = lambda i: i / n
    west, south, width, height = box["x1"], box["y1"], box["x2"] - box["x1"], box["y2"] - box["y1"]
    edge = F.array(*(F.lit(part(i)) for i in range(n)))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.concat(
        F.transform(edge, lambda p: at(west + width * p, south)),
        F.transform(edge, lambda p: at(box["x2"], south + height * p)),
        F.transform(edge, lambda p: at(box["x2"] - width * p, box["y2"])),
        F.transform(edge, lambda p: at(west, box["y2"] - height * p)),
    )
    degrees = F.transform(ring, lambda p: to_degrees(p["x"], p["y"], source))
    # Longitudes beside the first one, so that a box over the antimeridian stays in one piece.
    joined = lambda ds: F.transform(ds, lambda d: F.struct((F.get(ds, F.lit(0))["x"] + wrapped(d["x"] - F.get(ds, F.lit(0))["x"])).alias("x"), d["y"].alias("y")))
    points = F.when(source == target, ring).when(target == 4326, F.when((source == 4326) | (source == 3857), degrees).otherwise(through(degrees, joined))).otherwise(F.transform(degrees, lambda d: from_degrees(d["x"], d["y"], target)))

    def limits(ps: Column) -> Column:
        side = lambda f, k: f(F.transform(ps, lambda p: p[k]))
        found = F.struct(*(side(f, k).alias(n) for n, f, k in (("x1", F.array_min, "x"), ("y1", F.array_min, "y"), ("x2", F.array_max, "x"), ("y2", F.array_max, "y"))))
        return F.when(F.forall(ps, lambda p: p.isNotNull()), found)

    def geographic(b: Column) -> Column:
        pole = F.when(is_north(source), POLE).otherwise(SOUTH - POLE)
        around = is_utm(source) & (box["x1"] <= EAST) & (box["x2"] >= EAST) & (box["y1"] <= pole) & (box["y2"] >= pole)
        cap = F.struct(F.lit(-180.0).alias("x1"), F.when(is_north(source), b["y1"]).otherwise(-90.0).alias("y1"), F.lit(180.0).alias("x2"), F.when(is_north(source), 90.0).otherwise(b["y2"]).alias("y2"))
        turned = F.struct(F.when(b["x1"] < -180.0, b["x1"] + 360.0).otherwise(b["x1"]).alias("x1"), b["y1"], F.when(b["x2"] > 180.0, b["x2"] - 360.0).otherwise(b["x2"]).alias("x2"), b["y2"])
        return F.when(b.isNull(), None).when(around, cap).when(is_utm(source), turned).otherwise(b)

    found = through(points, limits)
    fine = known(source) & known(target) & (width >= 0) & (height >= 0)
    return F.when(fine, F.when((target == 4326) & (source != 4326), through(found, geographic)).otherwise(found))
