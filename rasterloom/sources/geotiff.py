"""GeoTIFF files as DataFrames: Spark reads the bytes (``binaryFile``), tasks parse them.

Supported: one image a file, strips or tiles, no compression or DEFLATE, predictors 1 and 2, whole numbers of 8 and 16
bits and floats of 32 and 64, planar or interleaved bands, GDAL's nodata and metadata tags, affine transforms, and the
EPSG code of the geo keys. Anything else is an error for that file, never a guess.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Tag numbers, bytes of a value by field type, numpy kinds by (sample format, bits).
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "bands", 278: "rows_per_strip", 279: "counts", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "counts", 339: "format", 33550: "scale", 33922: "tiepoint", 34264: "matrix", 34735: "geokeys", 42112: "metadata", 42113: "nodata"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
KINDS = {(1, 8): "u1", (1, 16): "u2", (2, 16): "i2", (3, 32): "f4", (3, 64): "f8"}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}

META = "path string, sha256 string, width int, height int, bands int, dtype string, nodata double, crs string, transform struct<a: double, b: double, c: double, d: double, e: double, f: double>, tags map<string, string>, status string"
TILES = "path string, band int, tile_row int, tile_col int, height int, width int, data array<double>, status string"
#: A file of more pixels than this is refused before its pixels are read.
MAX_PIXELS = 150_000_000
#: How many bytes of a file some bytes at a place are: bytes in memory, or a file that is read by ranges.
Read = Callable[[int, int], bytes]


def in_memory(raw: bytes) -> Read:
    return lambda at, n: raw[at : at + n]


def parse(read: Read) -> tuple[dict, str]:
    """Tags by name, and the byte order; only the directory is read."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", head[4:8])
    (n,) = struct.unpack(order + "H", read(at, 2))
    entries = read(at + 2, 12 * n + 4)
    found: dict = {}
    for i in range(n):
        entry = entries[12 * i : 12 * i + 12]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if tag not in TAGS or kind not in SIZES:
            continue
        size = SIZES[kind] * count
        body = entry[8 : 8 + size] if size <= 4 else read(struct.unpack(order + "I", entry[8:12])[0], size)
        found[TAGS[tag]] = body.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else struct.unpack(order + str(count) + CODES[kind], body) if kind in CODES else ()
    if struct.unpack(order + "I", entries[12 * n :])[0]:
        raise ValueError("a file of several images")
    return found, order


def describe(raw: bytes) -> dict:
    return described(parse(in_memory(raw))[0])


def described(t: dict) -> dict:
    """What the tags tell of the raster."""
    bits, form = set(t.get("bits", (1,))), set(t.get("format", (1,)))
    kind = KINDS.get((form.pop(), bits.pop())) if len(bits) == len(form) == 1 else None
    if kind is None:
        raise ValueError("bands of an unknown or of several types")
    if "matrix" in t:
        m = t["matrix"]
        affine = dict(zip("abcdef", (m[0], m[1], m[3], m[4], m[5], m[7])))
    elif "scale" in t and "tiepoint" in t:
        (sx, sy, *_), p = t["scale"], t["tiepoint"]
        affine = dict(zip("abcdef", (sx, 0.0, p[3] - p[0] * sx, 0.0, -sy, p[4] + p[1] * sy)))
    else:
        affine = None
    keys = t.get("geokeys", ())
    entries = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    code = entries.get(3072) or entries.get(2048)
    tags = dict(re.findall(r'<Item name="([^"]+)"[^>]*>([^<]*)</Item>', t.get("metadata", "")))
    nodata = float(t["nodata"]) if t.get("nodata", "").strip() else None
    return {"width": t["width"][0], "height": t["height"][0], "bands": t.get("bands", (1,))[0], "dtype": kind, "nodata": nodata, "crs": f"EPSG:{code}" if code and code != 32767 else None, "transform": affine, "tags": tags}


def decoded(body: bytes, squeeze: int) -> bytes:
    return zlib.decompress(body) if squeeze != 1 else body


def window(read: Read, t: dict, order: str, top: int, bottom: int, wanted: list[int]) -> np.ndarray:
    """(wanted bands from 1, rows top..bottom, width) as float64, NaN where nodata. Only blocks that hold some of it are read and decoded."""
    d = described(t)
    w, h, n = d["width"], d["height"], d["bands"]
    if any(not 1 <= b <= n for b in wanted):
        raise ValueError("a band that the file does not have")
    squeeze, predictor = t.get("compression", (1,))[0], t.get("predictor", (1,))[0]
    if squeeze not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError("an unknown compression or predictor")
    tiled = "tile_width" in t
    bw, bh = (t["tile_width"][0], t["tile_height"][0]) if tiled else (w, min(t.get("rows_per_strip", (h,))[0], h))
    across, down = -(-w // bw), -(-h // bh)
    apart = t.get("planar", (1,))[0] == 2
    out = np.empty((len(wanted), bottom - top, w))
    for k, band in enumerate(wanted) if apart else [(slice(None), None)]:
        for row in range(top // bh, -(-bottom // bh)):
            for col in range(across):
                i = ((band - 1) * down if apart else 0) * across + row * across + col
                rows, deep = bh if tiled else min(bh, h - row * bh), 1 if apart else n
                block = np.frombuffer(decoded(read(t["offsets"][i], t["counts"][i]), squeeze), order + d["dtype"], rows * bw * deep).reshape(rows, bw, deep)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
                lo, hi = max(top, row * bh), min(bottom, row * bh + rows, h)
                part = block[lo - row * bh : hi - row * bh, : w - col * bw]
                part = part[:, :, 0] if apart else part[:, :, [b - 1 for b in wanted]].transpose(2, 0, 1)
                out[k, lo - top : hi - top, col * bw : col * bw + part.shape[-1]] = part
    if d["nodata"] is not None:
        out[out == d["nodata"]] = np.nan
    return out


def pixels(raw: bytes, wanted: list[int] | None = None) -> np.ndarray:
    """(bands, height, width) of the wanted bands (from 1; None: all) as float64, NaN where nodata."""
    t, order = parse(in_memory(raw))
    d = described(t)
    if d["width"] * d["height"] > MAX_PIXELS:
        raise ValueError("too many pixels")
    return window(in_memory(raw), t, order, 0, d["height"], wanted or list(range(1, d["bands"] + 1)))


def as_tiles(path: str, bands: list[int], grid: np.ndarray, tile_row: int, side: int) -> pa.RecordBatch:
    """Tile rows of a row of tiles; masked and non-finite cells are null."""
    _, h, w = grid.shape
    cols = range(0, w, side)
    flat = np.concatenate([grid[k, :, x : x + side].ravel() for k in range(len(bands)) for x in cols])
    sizes = [h * min(side, w - x) for _ in bands for x in cols]
    data = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.float64(), mask=~np.isfinite(flat)))
    n, ints = len(sizes), lambda v: pa.array(v, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n), ints([b for b in bands for _ in cols]), ints([tile_row] * n), ints([x // side for _ in bands for x in cols]), ints([h] * n), ints([min(side, w - x) for _ in bands for x in cols]), data, pa.array(["OK"] * n)],
        names=[f.split()[0] for f in TILES.split(", ")],
    )


def bad_file(path: str, error: Exception) -> pa.RecordBatch:
    none = lambda kind: pa.array([None], kind)
    return pa.RecordBatch.from_arrays([pa.array([path]), *(none(pa.int32()) for _ in range(5)), none(pa.list_(pa.float64())), pa.array([f"{type(error).__name__}: {error}"])], names=[f.split()[0] for f in TILES.split(", ")])


#: What a file that can't be read raises.
FAULTS = (ValueError, KeyError, IndexError, struct.error, zlib.error, OSError)


def _bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: size, type, nodata, CRS, transform, tags and SHA-256; a file that can't be read has its error as status."""

    def one(path: str, raw: bytes) -> dict:
        row = {"path": path, "sha256": hashlib.sha256(raw).hexdigest()}
        try:
            return row | describe(raw) | {"status": "OK"}
        except FAULTS as e:
            return row | dict.fromkeys(("width", "height", "bands", "dtype", "nodata", "crs", "transform", "tags")) | {"status": f"{type(e).__name__}: {e}"}

    def run(frames):
        for f in frames:
            yield pd.DataFrame([one(p, c) for p, c in zip(f["path"], f["content"])]).astype({"width": "Int32", "height": "Int32", "bands": "Int32"})

    return _bytes(spark, path).mapInPandas(run, META)


def read_tiles(spark: SparkSession, path: str, bands: list[int] | None = None, size: int = 256) -> DataFrame:
    """Tile rows of the wanted bands, which alone are decoded; through Spark's own reader, so from any store, a file as a whole.

    A file that can't be read is one row with its error as status. For large files on a store with ranges: ``raster_source``."""

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    t, order = parse(in_memory(raw))
                    d = described(t)
                    if d["width"] * d["height"] > MAX_PIXELS:
                        raise ValueError("too many pixels")
                    asked = bands or list(range(1, d["bands"] + 1))
                    for y in range(0, d["height"], size):
                        yield as_tiles(p, asked, window(in_memory(raw), t, order, y, min(y + size, d["height"]), asked), y // size, size)
                except FAULTS as e:
                    yield bad_file(p, e)

    return _bytes(spark, path).mapInArrow(run, TILES)


def header(kind: str, shape: tuple[int, int, int], rows_per_strip: int, counts: list[int], at: int, starts: list[int], transform: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float | None = None, compress: bool = True) -> bytes:
    """The directory of a planar, little-endian file of strips, to stand at ``at``."""
    form, bits = next(k for k, v in KINDS.items() if v == kind)
    n, h, w = shape
    fields = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (bits,) * n), (259, 3, (8 if compress else 1,)), (262, 3, (1,)), (273, 4, tuple(starts)), (277, 3, (n,)), (278, 4, (rows_per_strip,)), (279, 4, tuple(counts)), (284, 3, (2,)), (339, 3, (form,) * n)]
    if transform:
        a, b, c, d, e, f = transform
        fields.append((34264, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    if epsg:
        fields.append((34735, 3, (1, 1, 0, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)))
    if nodata is not None:
        fields.append((42113, 2, f"{nodata:g}\0".encode()))
    body = lambda kind, v: v if kind == 2 else struct.pack("<" + str(len(v)) + CODES[kind], *v)
    extra, entries, spare = b"", [], at + 2 + 12 * len(fields) + 4
    for tag, code, value in sorted(fields):
        b = body(code, value)
        place = b.ljust(4, b"\0") if len(b) <= 4 else struct.pack("<I", spare + len(extra))
        extra += (b + b"\0" * (len(b) % 2)) if len(b) > 4 else b""
        entries.append(struct.pack("<HHI", tag, code, len(value)) + place)
    return struct.pack("<H", len(fields)) + b"".join(entries) + b"\0\0\0\0" + extra


def encode(grid: np.ndarray, transform: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float | None = None, compress: bool = True, rows_per_strip: int | None = None) -> bytes:
    """A GeoTIFF of (bands, height, width)."""
    kind = grid.dtype.newbyteorder("=").str[1:]
    rows = rows_per_strip or grid.shape[1]
    strips = [grid[i, y : y + rows].astype("<" + kind).tobytes() for i in range(grid.shape[0]) for y in range(0, grid.shape[1], rows)]
    strips = [zlib.compress(s) for s in strips] if compress else strips
    counts = list(map(len, strips))
    starts = (8 + np.cumsum([0, *counts])).tolist()
    return b"II*\0" + struct.pack("<I", starts[-1]) + b"".join(strips) + header(kind, grid.shape, rows, counts, starts[-1], starts[:-1], transform, epsg, nodata, compress)


def png(rgba: np.ndarray) -> bytes:
    """A PNG of (height, width, 4) bytes."""
    h, w, _ = rgba.shape
    raw = b"".join(b"\0" + rgba[y].astype("u1").tobytes() for y in range(h))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
