from pyspark.sql import functions as F

from rasterloom.functions import records as C
from rasterloom.operators import evidence as E


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def strings(*v):
    return F.array(*(F.lit(x).cast("string") for x in v))


def test_records(spark):
    box = F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (-5, 2, 50, 9))))
    tags = F.create_map(F.lit("a:sensor-name"), F.lit(" "), F.lit("TIFF:Platform"), F.lit(" s1 "))
    window = F.struct(*(F.lit(float(v)).alias(k) for k, v in (("col_off", 10), ("row_off", 20), ("width", 100), ("height", 50))))
    r = one(
        spark,
        bands=C.missing_bands(("NIR", "RED", "GREEN"), strings("Near-Infrared", None, "B04")),
        tag=C.first_tag(tags, "SENSOR_NAME", "PLATFORM"),
        kind=C.modality(F.lit(" radar ")),
        other=C.modality(F.lit("lidar")),
        unknown=C.radar_semantics_unknown(F.lit("sar"), strings("VV"), F.lit(None).cast("string"), F.lit(None).cast("string")),
        gray=C.display_bands(F.lit("sar"), F.lit(4), strings("red")),
        rgb=C.display_bands(F.lit("optical"), F.lit(4), strings("blue", "green", "red", "nir")),
        plain=C.display_bands(F.lit("optical"), F.lit(4), strings("a", "b", "c")),
        tile=C.tile_in_domain(F.lit(2), F.lit(3), F.lit(4)),
        name=C.file_name(F.lit("a\\b/c.tif")),
        bad=C.file_name(F.lit("a/..")),
        span=C.content_range(F.lit("bytes 0-9/100")),
        crop=C.crop_to_source(F.lit(50.0), F.lit(50.0), window, F.lit(100.0), F.lit(100.0)),
        clip=C.clip_box(box, F.lit(40.0), F.lit(8.0)),
        size=C.fitted_size(F.lit(300), F.lit(1), 150),
        edge=C.short_edge_size(F.lit(100), F.lit(400), 800, 1333),
        z=C.standardised(F.array(F.lit(1.0), F.lit(3.0)), 1.0, 2.0),
        zn=C.standardised(F.array(F.lit(1.0), F.lit(None).cast("double")), 1.0, 2.0),
        hot=C.one_hot(strings("b", "c"), ("a", "b")),
        ready=C.capability_status(F.lit(False), F.lit(True), F.lit(True), F.lit(False)),
    )
    assert r.bands == ["GREEN"] and r.tag == "s1" and (r.kind, r.other, r.unknown) == ("sar", "unknown", True)
    assert (r.gray, r.rgb, r.plain, r.tile, r.name, r.bad) == ([1], [3, 2, 1], [1, 2, 3], False, "c.tif", None)
    assert tuple(r.span) == (0, 9, 100) and tuple(r.crop) == (60.0, 45.0) and tuple(r.clip) == (0.0, 2.0, 40.0, 8.0)
    assert tuple(r.size) == (150, 1) and tuple(r.edge) == (333, 1333) and r.z == [0.0, 1.0] and r.zn is None and r.hot == [0, 1] and r.ready == "UNAVAILABLE_RUNTIME"


def test_stores(spark):
    a = spark.createDataFrame([("k1", "h1"), ("k2", "h2")], "key_hash string, request_hash string")
    b = spark.createDataFrame([("k1", "h1"), ("k2", "x"), ("k3", "h3")], a.schema)
    assert {r.key_hash: r.outcome for r in E.submissions(a, b).collect()} == {"k1": "REPLAY", "k2": "CONFLICT", "k3": "NEW"}
    assert sorted((r.key_hash, r.side) for r in E.set_difference(a, b).collect()) == [("k2", "first"), ("k2", "second"), ("k3", "second")]
    assert [r.request_hash for r in E.copy_as(a, "key_hash", "k1", "k9").collect()] == ["h1"]
    assert {(r.key_hash, r.other) for r in E.derangement(b, "key_hash").collect()} == {("k1", "k2"), ("k2", "k3"), ("k3", "k1")}
    jobs = spark.createDataFrame([("a", "RUNNING"), ("b", "QUEUED")], "job_id string, status string")
    assert {r.job_id: r.status for r in E.interrupted(jobs).collect()} == {"a": "INTERRUPTED", "b": "QUEUED"}
    assert E.insert_if_absent(a, b.withColumn("i", F.lit(1)), "key_hash", "i").count() == 1
