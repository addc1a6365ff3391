"""Reports in order, cancellation, map tiles as files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import jobs, reports, tiles

DAY = dt.datetime(2024, 1, 1)


def _report(spark):
    a = spark.createDataFrame([(1, "SUCCEEDED", "s", "t", '{"query":"<q>","reasons":["r","r","",5],"plan":{"steps":"none"},"verification":{"answered":true,"issues":[]}}'), (2, "FAILED", "s", "t", None)], "analysis_id int, status string, created_at string, updated_at string, payload string")
    e = spark.createDataFrame([(1, "b", DAY, "x"), (1, "a", DAY, ""), (1, "z", DAY - dt.timedelta(1), None), (9, "lost", DAY, "x")], "analysis_id int, evidence_id string, created_at timestamp, task string")
    g = spark.createDataFrame([(1, "s", "t2", "D"), (1, "s", "t1", "D"), (1, "s", "t1", "D")], "analysis_id int, source string, target string, edge_type string")
    f = spark.createDataFrame([(1, "f", "a", "image/png", "0", 1)], "analysis_id int, artifact_id string, evidence_id string, media_type string, sha256 string, size_bytes long")
    j = spark.createDataFrame([("j1", 1), ("j0", 1)], "job_id string, analysis_id int")
    v = spark.createDataFrame([("j1", 1, "B", DAY), ("j1", 0, "A", DAY), ("j0", 5, "C", DAY), ("j9", 0, "A", DAY)], "job_id string, sequence long, event_type string, created_at timestamp")
    return reports.report_rows(a, e, g, f, j, v)


def test_report_lines_are_written_in_order(spark, tmp_path):
    reports.written(_report(spark), str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r")).orderBy(*reports.ORDER).collect()
    told = [(r.analysis_id, r.section, r.html.replace("</td><td>", "|")[8:-10]) for r in rows]
    assert told == [
        (1, "summary", "SUCCEEDED|s|t"), (1, "query", "query|&lt;q&gt;"), (1, "evidence", "z|unknown"), (1, "evidence", "a|unknown"), (1, "evidence", "b|x"), (1, "verification", "passed|true"),
        (1, "trace", "j0|5|C"), (1, "trace", "j1|0|A"), (1, "trace", "j1|1|B"), (1, "artifacts", "f|a|image/png|0|1"), (1, "warnings", "warning|r"), (1, "edges", "t1|s|D"), (1, "edges", "t2|s|D"),
        (2, "summary", "FAILED|s|t"), (2, "query", "query|"),
    ]
    with pytest.raises(Exception, match="(?i)exist"):
        reports.written(_report(spark), str(tmp_path / "r"))


def test_cancellation(spark):
    j = spark.createDataFrame([("q", "QUEUED"), ("r", "RUNNING"), ("d", "SUCCEEDED"), ("c", "CANCEL_REQUESTED")], "job_id string, status string")
    asked = spark.createDataFrame([(k, t) for k in "qrdcx" for t in (2, 1)], "job_id string, at int")
    got = {r.job_id: (r.at, r.n_requests, r.outcome, r.event) for r in jobs.cancel_requests(j, asked).collect()}
    assert got == {"q": (1, 2, "CANCELLED", "CANCELLED"), "r": (1, 2, "CANCEL_REQUESTED", "CANCEL_REQUESTED"), "d": (1, 2, "CONFLICT", None), "c": (1, 2, "CONFLICT", None), "x": (1, 2, "UNKNOWN", None)}
    steps = spark.createDataFrame([("a", 1, 4), ("a", 4, 5), ("a", 5, 9), ("a", 4, None), ("b", 1, 2), ("b", 2, None), ("b", None, None)], "job_id string, started int, ended int")
    got = jobs.step_outcomes(steps, spark.createDataFrame([("a", 5)], "job_id string, at int")).collect()
    assert sorted((r.job_id, r.started or 0, r.ended or 0, r.outcome) for r in got) == [("a", 1, 4, "PUBLISHED"), ("a", 4, 0, "DISCARDED"), ("a", 4, 5, "DISCARDED"), ("a", 5, 9, "SKIPPED"), ("b", 0, 0, "PENDING"), ("b", 1, 2, "PUBLISHED"), ("b", 2, 0, "RUNNING")]


def test_map_tiles_as_files(spark):
    """Three colours of a raster without a coordinate system, at its own size, and a tile outside the level."""
    data = [[float(17 * i) for i in range(4)], [0.0, 255.0, 300.0, -1.0], [None, 1.4, 1.6, 9.0], [255.0, 0.0, 255.0, 255.0]]
    t = spark.createDataFrame([("o", b, 0, 0, 2, 2, d) for b, d in enumerate(data)], "observation string, band int, tile_row int, tile_col int, height int, width int, data array<double>")
    source = F.struct(*(F.lit(v).alias(k) for k, v in zip("abcdef", (1.0, 0.0, 0.0, 0.0, -1.0, 0.0))), F.lit(2).alias("width"), F.lit(2).alias("height"), F.lit(None).cast("int").alias("crs"))
    asked = spark.createDataFrame([(1, "o", 0, 0, 0), (2, "o", 0, 1, 0), (3, "o", 25, 0, 0)], "pair int, observation string, z int, x int, y int").withColumn("source", source)
    found = tiles.render(t, asked, 2, (0, 1, 2), 3, size=2)
    rows = found.collect()
    assert [(r.pair, r.red, r.green, r.blue, r.alpha) for r in rows] == [(1, [0, 17, 34, 51], [0, 255, 255, 0], [0, 1, 2, 9], [255, 0, 255, 255])]
    png = tiles.encoded(found, 2).first().png
    assert bytes(png[:8]) == b"\x89PNG\r\n\x1a\n"
