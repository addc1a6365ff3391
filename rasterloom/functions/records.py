"""Column functions over observation records: tags, bands, names, windows, boxes, model inputs, public views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a band role.
BAND_ALIASES = {
    "RED": ("red", "b04", "b4"),
    "GREEN": ("green", "b03", "b3"),
    "BLUE": ("blue", "b02", "b2"),
    "NIR": ("nir", "near infrared", "b08", "b8"),
    "SWIR1": ("swir1", "swir 1", "short wave infrared 1", "b11"),
}
# Words that name a sensor's modality.
MODALITIES = {"SAR": "sar", "RADAR": "sar", "OPTICAL": "optical", "RGB": "optical", "MULTISPECTRAL": "multispectral", "MSI": "multispectral"}


def plain_words(x: Column) -> Column:
    """Lower case, - and _ as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(x, "-_", "  ")), r"\s+", " "))


def has_band(role: str, descriptions: Column) -> Column:
    """Whether one of the bands' descriptions (array<string>) names the role; unknown roles are an error."""
    if role not in BAND_ALIASES:
        raise ValueError(f"unknown band role {role!r}")
    return F.arrays_overlap(F.transform(F.filter(descriptions, lambda d: d.isNotNull()), plain_words), F.array(*map(F.lit, BAND_ALIASES[role])))


def missing_bands(roles: tuple[str, ...], descriptions: Column) -> Column:
    """The roles that no band names, in alphabetical order."""
    return F.filter(F.array(*(F.when(~has_band(r, descriptions), F.lit(r)) for r in sorted(roles))), lambda x: x.isNotNull())


def tag_key(key: Column) -> Column:
    """The part after the last colon in upper case, letters and digits only."""
    return F.regexp_replace(F.upper(F.element_at(F.split(key, ":"), -1)), "[^A-Z0-9]", "")


def first_tag(tags: Column, *names: str) -> Column:
    """The first of the named tags that has a value that is not blank; names are compared in plain form."""
    named = lambda n: F.transform(F.filter(F.map_entries(tags), lambda e: tag_key(e["key"]) == tag_key(F.lit(n))), lambda e: F.trim(e["value"]))
    value = lambda n: F.get(F.filter(named(n), lambda v: v != ""), F.lit(0))
    return F.coalesce(*(value(n) for n in names))


def modality(tag: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MODALITIES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(tag))), F.lit("unknown"))


def radar_semantics_unknown(kind: Column, pols: Column, domain: Column, sensor: Column) -> Column:
    """A radar observation without polarisations, or without both a radiometric domain and a sensor."""
    return (kind == "sar") & ((F.size(pols) == 0) | (domain.isNull() & sensor.isNull()))


def display_bands(kind: Column, count: Column, colours: Column) -> Column:
    """Band numbers to show: the first alone for radar or under three bands; else those marked red, green and blue; else 1, 2, 3."""
    place = lambda c: F.array_position(colours, c).cast("int")
    marked = F.array(place("red"), place("green"), place("blue"))
    return F.when((kind == "sar") | (count < 3), F.array(F.lit(1))).when(F.forall(marked, lambda x: x > 0), marked).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))


def tile_in_domain(z: Column, x: Column, y: Column, most: int = 24) -> Column:
    side = F.pow(F.lit(2.0), z)
    return z.between(0, most) & (x >= 0) & (y >= 0) & (x < side) & (y < side)


def file_name(name: Column, longest: int = 255) -> Column:
    """The last part of a path; null for control characters, dots only, an empty or too long name."""
    last = F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1)
    return F.when(~last.rlike(r"[\x00-\x1F\x7F]") & ~last.isin("", ".", "..") & (F.length(last) <= longest), last)


def content_range(x: Column) -> Column:
    """struct(first, last, total) of 'bytes a-b/n'; null for other text."""
    part = lambda i: F.regexp_extract(x, r"^bytes (\d{1,18})-(\d{1,18})/(\d{1,18})$", i)
    number = lambda i: F.when(part(i) != "", part(i)).cast("long")
    return F.when(part(1) != "", F.struct(number(1).alias("first"), number(2).alias("last"), number(3).alias("total")))


def crop_to_source(col: Column, row: Column, window: Column, width: Column, height: Column) -> Column:
    """A place in a rendered crop to the source: window (col_off, row_off, width, height) over the rendered size."""
    return F.struct((window["col_off"] + col * window["width"] / width).alias("col"), (window["row_off"] + row * window["height"] / height).alias("row"))


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """The box within an image; null if nothing is left."""
    inside = {"x1": F.greatest(box["x1"], F.lit(0.0)), "y1": F.greatest(box["y1"], F.lit(0.0)), "x2": F.least(box["x2"], width), "y2": F.least(box["y2"], height)}
    return F.when((inside["x2"] > inside["x1"]) & (inside["y2"] > inside["y1"]), F.struct(*(c.alias(k) for k, c in inside.items())))


def scale_box(box: Column, x: Column, y: Column) -> Column:
    return F.struct((box["x1"] * x).alias("x1"), (box["y1"] * y).alias("y1"), (box["x2"] * x).alias("x2"), (box["y2"] * y).alias("y2"))


def fitted_size(width: Column, height: Column, most_width: int, most_height: int | None = None) -> Column:
    """struct(width, height) of an image within a box (or a square), by one ratio, halves to even, at least 1."""
    ratio = F.least(F.lit(float(most_width)) / width, F.lit(float(most_height or most_width)) / height)
    return F.struct(F.greatest(F.lit(1), F.rint(width * ratio).cast("int")).alias("width"), F.greatest(F.lit(1), F.rint(height * ratio).cast("int")).alias("height"))


def short_edge_size(width: Column, height: Column, shortest: int, longest: int) -> Column:
    """Size of a given shorter edge, unless the longer one would pass its cap."""
    ratio = F.least(F.lit(float(shortest)) / F.least(width, height), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.rint(width * ratio).cast("int")).alias("width"), F.greatest(F.lit(1), F.rint(height * ratio).cast("int")).alias("height"))


def standardised(values: Column, mean: float, deviation: float) -> Column:
    """(value - mean) / deviation; null as a whole where a value is masked, as a model must not see it."""
    scaled = F.transform(values, lambda v: ((v - mean) / deviation).cast("float"))
    return F.when(F.forall(values, lambda v: F.abs(v) < F.lit(float("inf"))), scaled)


def one_hot(labels: Column, classes: tuple[str, ...]) -> Column:
    return F.array(*(F.array_contains(labels, c).cast("int") for c in classes))


def sorted_distinct(labels: Column) -> Column:
    return F.array_sort(F.array_distinct(labels))


def visual_gap(correct: Column, blank: Column, shuffled: Column) -> Column:
    """How much better than the better of the two answers without the image."""
    return correct - F.greatest(blank, shuffled)


def without_paths(doc: Column, *fields: str) -> Column:
    """A struct without its local path fields."""
    return doc.dropFields(*fields)


def capability_status(blocked: Column, promoted: Column, tools_ready: Column, models_ready: Column) -> Column:
    """The first reason for which a capability is not available; AVAILABLE if there is none."""
    return F.when(blocked, "BLOCKED").when(~promoted, "UNAVAILABLE_NOT_PROMOTED").when(~tools_ready, "UNAVAILABLE_TOOL").when(~models_ready, "UNAVAILABLE_RUNTIME").otherwise("AVAILABLE")
