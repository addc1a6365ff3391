"""GeoTIFF files as a Spark data source: large rasters in many partitions, read by ranges, and written by one commit.

``register(spark)``, then ``spark.read.format("rasterloom_tiff").load(folder)`` gives the rows of ``geotiff.TILES``.

Reading: a partition is a run of tile rows of a file, so a file of any size is spread; a task reads the directory and
those blocks that hold its rows, in batches of one row of tiles. A filter ``band = n`` or ``band IN (...)`` is pushed to
the reader: blocks of other bands are not decoded, and
of a file with separate planes not even read. A file that can't be read is one row with its error as ``status``.

Writing: ``write`` brings each file's tiles together, in order; a task appends strip after strip (one row of tiles of a
band) to a file under a hidden name and its directory at the end, so it holds one strip and 16 bytes for each one
written. The driver renames all files once all tasks are done, or deletes them. Files are of at most 4 GiB.

Paths: local ones, and the stores of pyarrow (s3, gs, hdfs). Stores that only Spark opens: ``geotiff.read_tiles``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from . import geotiff as G

NAME = "rasterloom_tiff"
#: Cells of a partition, in all bands.
CELLS = 4_000_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def ranged(file) -> G.Read:
    return lambda at, n: file.read_at(n, at)


@dataclass
class Rows(InputPartition):
    """Tile rows first..last of a file; an error where its directory could not be read."""

    path: str
    first: int
    last: int
    error: str = ""


class RasterReader(DataSourceReader):
    def __init__(self, path: str, side: int, cells: int):
        self.path, self.side, self.cells, self.bands = path, side, cells, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("band",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.bands = asked if self.bands is None else self.bands & asked
            else:
                yield f

    def partitions(self) -> list[Rows]:
        system, base = opened(self.path)
        info = system.get_file_info(base)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
        out = []
        for f in sorted((f.path for f in files if f.is_file and f.base_name.lower().endswith((".tif", ".tiff")))):
            try:
                with system.open_input_file(f) as file:
                    d = G.described(G.parse(ranged(file))[0])
                rows = -(-d["height"] // self.side)
                step = max(1, self.cells // max(1, d["width"] * self.side * d["bands"]))
                out += [Rows(f, at, min(at + step, rows)) for at in range(0, rows, step)]
            except G.FAULTS as e:
                out.append(Rows(f, 0, 0, f"{type(e).__name__}: {e}"))
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.error:
            # A row without a band: no filter by band keeps it.
            if self.bands is None:
                yield G.bad_file(part.path, ValueError(part.error))
            return
        try:
            with opened(self.path)[0].open_input_file(part.path) as file:
                t, order = G.parse(ranged(file))
                d = G.described(t)
                bands = [b for b in range(1, d["bands"] + 1) if self.bands is None or b in self.bands]
                for row in range(part.first, part.last) if bands else ():
                    top = row * self.side
                    yield G.as_tiles(part.path, bands, G.window(ranged(file), t, order, top, min(top + self.side, d["height"]), bands), row, self.side)
        except G.FAULTS as e:
            if self.bands is None:
                yield G.bad_file(part.path, e)


@dataclass
class Written(WriterCommitMessage):
    files: list


class _Strips:
    """A file under a hidden name: strips as they come, the directory at the end."""

    def __init__(self, system: fs.FileSystem, hidden: str, final: str, options: dict):
        self.out, self.hidden, self.final, self.o = system.open_output_stream(hidden), hidden, final, options
        self.system, self.at, self.starts, self.counts, self.heights, self.width = system, 8, [], [], {}, None
        # The directory's place is known at the end only, so the first eight bytes are written then: strips go to a
        # stream of their own and are appended to the head.
        self.line: list = []

    def add(self, band: int, row: int, col: int, height: int, width: int, data) -> None:
        if self.line and (band, row) != self.line[0][:2]:
            self.flush()
        if col != len(self.line):
            raise ValueError(f"{self.final}: tile {col} of row {row} comes where {len(self.line)} is due")
        cells = np.array([np.nan if v is None else v for v in data], np.float64) if not isinstance(data, np.ndarray) else data
        self.line.append((band, row, cells.reshape(height, width)))

    def flush(self) -> None:
        if not self.line:
            return
        band, row, _ = self.line[0]
        grid = np.concatenate([x[2] for x in self.line], axis=1)
        own = self.heights.setdefault(band, [])
        if row != len(own) or self.width not in (None, grid.shape[1]) or band != len(self.heights):
            raise ValueError(f"{self.final}: a row of tiles is missing or of another width")
        own.append(grid.shape[0])
        self.width, self.line = grid.shape[1], []
        raw = zlib.compress(grid.astype("<" + self.o["dtype"]).tobytes())
        self.starts.append(self.at)
        self.counts.append(len(raw))
        self.at += len(raw)
        if self.at >= 1 << 32:
            raise ValueError(f"{self.final}: over 4 GiB")
        self.out.write(raw)

    def close(self) -> None:
        self.flush()
        self.out.close()
        heights = list(self.heights.values())
        if any(h != heights[0] for h in heights):
            raise ValueError(f"{self.final}: bands of several sizes")
        shape = (len(heights), sum(heights[0]), self.width)
        tail = G.header(self.o["dtype"], shape, heights[0][0], self.counts, self.at, self.starts, self.o["transform"], self.o["epsg"], np.nan)
        with self.system.open_output_stream(self.hidden + ".whole") as out, self.system.open_input_stream(self.hidden) as strips:
            out.write(b"II*\0" + struct.pack("<I", self.at))
            while chunk := strips.read(1 << 22):
                out.write(chunk)
            out.write(tail)
        self.system.delete_file(self.hidden)
        self.hidden += ".whole"


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, options: dict):
        self.folder, self.options, self.run = folder, options, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = opened(self.folder)
        hidden = f"{base}/_temporary-{self.run}"
        system.create_dir(hidden, recursive=True)
        now, files = None, []
        for b in iterator:
            lists = b.column(b.schema.get_field_index("data"))
            values = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", "band", "tile_row", "tile_col", "height", "width")]
            for i, (path, *place) in enumerate(zip(*cols)):
                if now is None or now.final != f"{base}/{path}":
                    if now:
                        now.close()
                        files.append((now.hidden, now.final))
                    now = _Strips(system, f"{hidden}/{uuid.uuid4().hex}", f"{base}/{path}", self.options)
                now.add(*place, values[ends[i] : ends[i + 1]])
        if now:
            now.close()
            files.append((now.hidden, now.final))
        return Written(files)

    def commit(self, messages: list) -> None:
        system, base = opened(self.folder)
        for m in messages:
            for hidden, final in m.files if m else ():
                system.move(hidden, final)
        self._clear(system, base)

    def abort(self, messages: list) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/_temporary-{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/_temporary-{self.run}")


class RasterSource(DataSource):
    """Options: path, side (cells of a tile's side, 256), cells (of a partition); to write: dtype, transform (six numbers), epsg."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return G.TILES

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"], int(self.options.get("side", 256)), int(self.options.get("cells", CELLS)))

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        transform = tuple(map(float, self.options["transform"].split(","))) if "transform" in self.options else None
        return RasterWriter(self.options["path"], {"dtype": self.options.get("dtype", "f8"), "transform": transform, "epsg": int(self.options["epsg"]) if "epsg" in self.options else None})


def register(spark: SparkSession) -> None:
    """Names the source in the session, and lets filters through to Python readers, without which Spark refuses it."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(tiles: DataFrame, folder: str, **options: str) -> None:
    """tiles: path (a name under ``folder``), band (from 1), tile_row, tile_col, height, width, data. Each file's tiles go to one task, in order."""
    register(tiles.sparkSession)
    names = ("path", "band", "tile_row", "tile_col", "height", "width", "data")
    ordered = tiles.select(*names).repartition("path").sortWithinPartitions(*names[:4])
    ordered.write.format(NAME).mode("append").options(**options).save(folder)
