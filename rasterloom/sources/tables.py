"""Checked table sources and write-once sinks: hash-pinned files, manifests, JSON lines, artifacts, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of every file; the hash is computed where the bytes are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def checked_parquet(spark: SparkSession, path: str, columns: list[str], sha256: str | None = None) -> DataFrame:
    """The named columns of a Parquet file; a missing column or another hash is an error before any row is read."""
    if sha256 is not None:
        found = [r.sha256 for r in file_hashes(spark, path).collect()]
        if found != [sha256]:
            raise ValueError(f"{path} is not the pinned file")
    df = spark.read.parquet(path)
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.select(*columns)


def manifest_samples(spark: SparkSession, path: str, sample: T.StructType, counts: dict[str, int] | None = None) -> DataFrame:
    """Rows of a manifest document's ``samples``; ``counts`` pins the rows of each split."""
    schema = T.StructType([T.StructField("samples", T.ArrayType(sample))])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("samples"))
    if counts is not None:
        found = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
        if found != counts:
            raise ValueError(f"split counts {found} are not {counts}")
    return rows


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One strict record a line: a malformed line fails the read, and so does an empty file."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"{path} has no record")
    return df


def write_once(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Fails where anything is at ``path`` already."""
    df.write.mode("errorifexists").format(form).save(path)


def corrupt_artifacts(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """Records (storage_key, sha256) whose file is missing or has another hash."""
    files = file_hashes(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("storage_key"), "sha256")
    return records.join(files, ["storage_key", "sha256"], "left_anti")


def registry(spark: SparkSession, text: str, allowed: set[str]) -> DataFrame:
    """Rows (section, key, value as JSON) of a YAML registry; repeated keys and unknown sections are errors."""
    import json

    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len(keys) != len(set(keys)):
            raise ValueError("a key is repeated")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    doc = yaml.load(text, Strict)
    if unknown := sorted(set(doc) - allowed):
        raise ValueError(f"unknown sections {unknown}")
    rows = [(s, str(k), json.dumps(v, sort_keys=True)) for s, part in doc.items() for k, v in (part.items() if isinstance(part, dict) else enumerate(part))]
    return spark.createDataFrame(rows, "section string, key string, value string")


def samples_by_band(samples: DataFrame, bands: list[str], template: str) -> DataFrame:
    """Each sample's path for each band; ``template`` has {id} and {band}."""
    path = F.replace(F.replace(F.lit(template), F.lit("{id}"), F.col("sample_id")), F.lit("{band}"), F.col("band"))
    return samples.select("*", F.explode(F.array(*map(F.lit, bands))).alias("band")).withColumn("path", path)


def repeated_paths(paths: DataFrame) -> DataFrame:
    """Paths that more than one sample and band would be written to; a set of samples with one is refused."""
    return paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def footprint(bounds: str = "bounds", crs: str = "crs") -> Column:
    """GeoJSON polygon of a bounds struct (left, bottom, right, top); without a CRS it is labelled as pixel space."""
    b = F.col(bounds)
    corner = lambda x, y: F.array(b[x], b[y])
    ring = F.array(corner("left", "bottom"), corner("right", "bottom"), corner("right", "top"), corner("left", "top"), corner("left", "bottom"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(F.coalesce(crs, F.lit("PIXEL_SPACE")).alias("crs")).alias("properties")))
