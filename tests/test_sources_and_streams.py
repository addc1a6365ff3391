import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.sources import geotiff as G
from rasterloom.sources import tables as S
from rasterloom.streaming import events as V


@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "f4", "f8"])
@pytest.mark.parametrize("compress", [True, False])
def test_geotiff_round_trip(kind, compress):
    grid = (np.arange(2 * 5 * 7).reshape(2, 5, 7) % 100).astype(kind)
    raw = G.encode(grid, (10, 0, 500, 0, -10, 900), 32633, 0, compress)
    d = G.describe(raw)
    assert (d["width"], d["height"], d["bands"], d["dtype"], d["nodata"], d["crs"]) == (7, 5, 2, kind, 0.0, "EPSG:32633") and d["transform"] == dict(zip("abcdef", (10, 0, 500, 0, -10, 900)))
    got = G.pixels(raw, [2])
    assert np.array_equal(np.nan_to_num(got[0]), grid[1].astype(float))
    assert np.isnan(G.pixels(raw)[0, 0, 0])
    with pytest.raises(ValueError):
        G.describe(b"PNG" + raw)


def test_geotiff_tables(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"o{i}.tif").write_bytes(G.encode(np.full((1, 4, 6), float(i + 1)), (10, 0, 0, 0, -10, 100), 32633, 1))
    meta = G.read_metadata(spark, str(tmp_path)).collect()
    assert len(meta) == 3 and {m.crs for m in meta} == {"EPSG:32633"} and all(len(m.sha256) == 64 for m in meta)
    tiles = G.read_tiles(spark, str(tmp_path), [1], size=4).collect()
    assert len(tiles) == 6 and {t.width for t in tiles} == {4, 2} and sum(v is None for t in tiles for v in t.data) == 24


def test_only_wanted_blocks_are_decoded(monkeypatch):
    grid = np.arange(3 * 40 * 10, dtype="f4").reshape(3, 40, 10)
    raw, seen = G.encode(grid, rows_per_strip=8), []
    decoded = G.decoded
    monkeypatch.setattr(G, "decoded", lambda body, squeeze: seen.append(1) or decoded(body, squeeze))
    t, order = G.parse(G.in_memory(raw))
    got = G.window(G.in_memory(raw), t, order, 10, 30, [2])
    assert np.array_equal(got[0], grid[1, 10:30]) and len(seen) == 3
    with pytest.raises(ValueError):
        G.window(G.in_memory(raw), t, order, 0, 8, [4])


def test_bad_files_are_rows(spark, tmp_path):
    (tmp_path / "good.tif").write_bytes(G.encode(np.full((2, 4, 6), 2.0), nodata=1))
    (tmp_path / "bad.tif").write_bytes(b"II*\0" + b"\1" * 20)
    (tmp_path / "cut.tif").write_bytes(G.encode(np.full((1, 400, 6), 2.0), compress=False)[:300])
    tiles = G.read_tiles(spark, str(tmp_path), size=4).collect()
    assert sum(t.status == "OK" for t in tiles) == 4 and {t.path.split("/")[-1] for t in tiles if t.status != "OK"} == {"bad.tif", "cut.tif"}
    assert sorted(m.status == "OK" for m in G.read_metadata(spark, str(tmp_path)).collect()) == [False, False, True]


def test_raster_source(spark, tmp_path):
    from rasterloom.sources import raster_source as R

    rng = np.random.default_rng(1)
    grids = {f"o{i}.tif": np.where(rng.random((3, 21, 13)) < 0.2, np.nan, rng.normal(size=(3, 21, 13))) for i in range(4)}
    rows = [(p, b + 1, y // 8, x // 8, *g[b, y : y + 8, x : x + 8].shape, [None if np.isnan(v) else float(v) for v in g[b, y : y + 8, x : x + 8].ravel()]) for p, g in grids.items() for b in range(3) for y in range(0, 21, 8) for x in range(0, 13, 8)]
    df = spark.createDataFrame(rows, "path string, band int, tile_row int, tile_col int, height int, width int, data array<double>")
    folder = str(tmp_path / "rasters")
    R.write(df, folder, transform="10,0,5,0,-10,9", epsg="32633")
    (tmp_path / "rasters" / "bad.tif").write_bytes(b"II")
    meta = [m for m in G.read_metadata(spark, folder).collect() if m.status == "OK"]
    assert len(meta) == 4 and all((m.bands, m.height, m.width, m.crs, m.transform.c) == (3, 21, 13, "EPSG:32633", 5.0) for m in meta)
    read = spark.read.format(R.NAME).option("side", 8).option("cells", 300).load(folder)
    got = {(r.path.split("/")[-1], r.band, r.tile_row, r.tile_col): r.data for r in read.where("status = 'OK'").collect()}
    assert got == {(r[0], *r[1:4]): r[6] for r in rows} and read.where("status <> 'OK'").count() == 1
    assert read.rdd.getNumPartitions() > 8
    assert {r.band for r in read.where("band in (2, 9)").select("band").collect()} == {2}
    reader = R.RasterReader(folder, 8, 300)
    assert list(reader.pushFilters([R.EqualTo(("band",), 2)])) == [] and reader.bands == {2}
    assert all(set(b.column(1).to_pylist()) == {2} for p in reader.partitions() for b in reader.read(p))
    with pytest.raises(Exception):
        R.write(df.where("tile_row <> 1"), str(tmp_path / "gaps"))
    assert not list((tmp_path / "gaps").rglob("*.tif*"))


def test_png():
    assert G.png(np.zeros((2, 3, 4), "u1"))[:8] == b"\x89PNG\r\n\x1a\n"


def test_manifests_and_lines(spark, tmp_path):
    sample = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("split", T.StringType())])
    (tmp_path / "m.json").write_text(json.dumps({"samples": [{"sample_id": "a", "split": "train"}, {"sample_id": "b", "split": "test"}]}))
    assert S.manifest_samples(spark, str(tmp_path / "m.json"), sample, {"train": 1, "test": 1}).count() == 2
    with pytest.raises(ValueError):
        S.manifest_samples(spark, str(tmp_path / "m.json"), sample, {"train": 2})
    (tmp_path / "l.jsonl").write_text('{"sample_id": "a", "split": "x"}\n')
    assert S.json_lines(spark, str(tmp_path / "l.jsonl"), sample).count() == 1
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError):
        S.json_lines(spark, str(tmp_path / "e.jsonl"), sample)
    df = spark.range(3)
    S.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception):
        S.write_once(df, str(tmp_path / "once"))
    with pytest.raises(ValueError):
        S.checked_parquet(spark, str(tmp_path / "once"), ["id", "no"])
    assert S.registry(spark, "tools:\n  a: {x: 1}\n", {"tools"}).count() == 1
    for bad in ("tools: {a: 1, a: 2}", "other: {}"):
        with pytest.raises(ValueError):
            S.registry(spark, bad, {"tools"})


def test_artifacts(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"1")
    good = S.file_hashes(spark, str(tmp_path)).first().sha256
    records = spark.createDataFrame([("x", good), ("x", "0" * 64), ("y", good)], "storage_key string, sha256 string")
    assert {(r.storage_key, r.sha256) for r in S.corrupt_artifacts(spark, str(tmp_path), records).collect()} == {("x", "0" * 64), ("y", good)}


def test_streams(spark, tmp_path):
    rows = [("a", i, k, "{}", f"2026-01-01 00:0{i}:00") for i, k in enumerate(("QUEUED", "RUNNING", "SUCCEEDED"))] + [("b", i, k, "{}", f"2026-01-01 00:0{i}:30") for i, k in ((0, "QUEUED"), (2, "RUNNING"))]
    df = spark.createDataFrame(rows, "job_id string, sequence long, event_type string, payload string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "events"))
    stream = V.event_stream(spark, str(tmp_path / "events"), df.schema)
    assert V.run_to_table(V.tail(stream, "a", 0), str(tmp_path / "tailed"), str(tmp_path / "c1")).count() == V.tail(df, "a", 0).count() == 2
    got = {r.job_id: (r.events, r.last, r.state, r.gap) for r in V.run_to_table(V.open_jobs(stream), str(tmp_path / "open_jobs"), str(tmp_path / "c2"), "update").collect()}
    assert got == {"a": (3, "SUCCEEDED", "CLOSED", False), "b": (2, "RUNNING", "OPEN", True)}
    counts = V.run_to_table(V.windowed_counts(stream, "ts", "1 minute", "10 minutes", "job_id"), str(tmp_path / "counts"), str(tmp_path / "c3"), "complete")
    assert counts.agg(F.sum("n")).first()[0] == 5
    assert V.frames(df).where("job_id = 'a' and sequence = 0").first().frame == "id: 0\nevent: QUEUED\ndata: {}\n\n"


def test_drains_do_not_depend_on_the_groups(spark, tmp_path):
    """Many jobs share a group's state and timer: over two batches they end as jobs by themselves do."""
    from datetime import datetime, timedelta

    from rasterloom.streaming.drains import STATE_STORE, drains
    from rasterloom.streaming.events import run_to_table

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    first = [("drained", at(1), 0, "FAILED", "x"), ("event", at(1), 0, "FAILED", "x"), ("stopped", at(2), 1, "INTERRUPTED", "x"), ("open", at(2), 3, None, "x"), ("early", at(1), 4, None, "job_succeeded"), ("early", at(2), 5, "SUCCEEDED", "x")]
    second = [("event", at(2.5), 1, None, "job_failed"), ("last", at(9), 0, "FAILED", "x"), ("stopped", at(9), 2, None, "x")]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, "job_id string, ts timestamp, sequence int, status string, event_type string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    read = spark.readStream.schema("job_id string, ts timestamp, sequence int, status string, event_type string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        for groups in (1, 2, 1000):
            got = run_to_table(drains(read, groups=groups), str(tmp_path / f"out{groups}"), str(tmp_path / f"state{groups}")).collect()
            assert sorted((r.job_id, r.closed_at, r.reason, r.last) for r in got) == [("drained", at(3), "DRAIN", -1), ("early", at(2), "EVENT", 4), ("event", at(2.5), "EVENT", 1), ("stopped", at(2), "INTERRUPTED", -1)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
