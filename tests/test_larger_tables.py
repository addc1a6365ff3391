"""Queries held against their SQL on rows that the smallest tables lack."""

import os

import duckdb

from rasterloom import queries as core
from rasterloom import raster_queries  # noqa: F401

from .oracle import TABLES, same

SF = "/root/testdata/sf0.001"


def folder(path, name, rows):
    """The smallest tables, with ``rows`` (SQL) for one of them."""
    for t in TABLES:
        if t != name:
            os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    duckdb.connect().execute(f"COPY ({rows}) TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path)


def holds(spark, sf_dir, name):
    same(spark, sf_dir, core.QUERIES[name], core.ORACLE_SQL[name])


def test_overlaps_at_half_a_millionth(spark, tmp_path):
    """Areas from rounded corners put 273437.5 millionths on the wrong side."""
    rows = "SELECT * FROM '/root/testdata/sf0.1/supplier.parquet' WHERE s_suppkey < 600"
    holds(spark, folder(tmp_path, "supplier", rows), "bbox_overlap_pairs")


def test_overlaps_of_scales_at_half_a_millionth(spark, tmp_path):
    """The same, with corners that are decimals in SQL."""
    rows = "SELECT * REPLACE (s_suppkey + r * 1000 AS s_suppkey) FROM '/root/testdata/sf0.1/supplier.parquet', range(6) g(r) WHERE (s_suppkey + r * 1000) % 6 IN (4, 5) AND s_suppkey < 400"
    holds(spark, folder(tmp_path, "supplier", rows), "bbox_overlap_scales")


def test_way_back_over_the_antimeridian(spark, tmp_path):
    """Customer 54000 lies at -180 degrees and comes back at 180, less the last bit."""
    rows = "SELECT * REPLACE (c_custkey + 54000 AS c_custkey) FROM '/root/testdata/sf0.1/customer.parquet' WHERE c_custkey < 50"
    holds(spark, folder(tmp_path, "customer", rows), "utm_places")


def test_pyramid_over_missing_tiles(spark, tmp_path):
    """A last raster of a row and a tile, and rasters with holes: no cells where there is no tile below."""
    rows = f"SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 53 AND vec_id NOT IN (3, 17, 18, 21, 22)"
    holds(spark, folder(tmp_path, "embeddings", rows), "display_pyramid")


def test_map_tiles_beside_missing_tiles(spark, tmp_path):
    """Places whose first cell lies in a missing tile take the cells of the tiles right of it and below."""
    rows = f"SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 96 AND vec_id NOT IN (0, 9, 16, 17, 26, 32, 34, 41, 42, 59, 64, 72, 81)"
    holds(spark, folder(tmp_path, "embeddings", rows), "rendered_tiles")
    holds(spark, str(tmp_path), "warp_bilinear")
