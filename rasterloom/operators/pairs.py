"""Compatibility of observation pairs: overlap, grid, time order, registration and overall status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..sources.shared import cut_lineage


#: Fixed value: boxes of a level in a block; a task compares two blocks of a cell at a time.
BLOCK = 2048


def _crossed(own: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """All meetings (a, p; b, q) of a level's own boxes with the others of their cell, each once.

    Cells of more than ``BLOCK`` boxes are cut into blocks by hash: a box of one side goes to one row of blocks and all
    its columns, one of the other to one column and all its rows, so a crowded cell is the work of many tasks."""
    cell = ["level", "gx", "gy"]
    blocks = lambda c: F.ceil(F.sum(c) / BLOCK).cast("int")
    crowd = every.groupBy(*cell).agg(blocks((F.col("own") == F.col("level")).cast("int")).alias("rows"), blocks(F.lit(1)).alias("columns")).where("rows > 0 and columns > 1")
    at = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), key), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = lambda d: d.join(F.broadcast(crowd), cell, "left").withColumns({"rows": F.coalesce("rows", F.lit(1)), "columns": F.coalesce("columns", F.lit(1))})
    large = sized(own).withColumn("r", at("rows", "row")).withColumn("c", all_("columns")).select(F.col(key).alias("a"), F.col("box").alias("p"), *cell, "r", "c")
    small = sized(every).withColumn("c", at("columns", "column")).withColumn("r", all_("rows")).select(F.col(key).alias("b"), F.col("box").alias("q"), "own", *cell, "r", "c")
    # By number: rows are few bytes and their meetings many, so partitions must not be merged by size.
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda d: d.repartition(n, *cell, "r", "c")
    return dealt(large).join(dealt(small), [*cell, "r", "c"]).where((F.col("own") < F.col("level")) | (F.col("a") < F.col("b")))


def overlapping(boxes: DataFrame, key: str = "id", area: str | None = None, least: float = 0.0) -> DataFrame:
    """(a, b, overlap) for pairs a < b of boxes (x1, y1, x2, y2) that share area.

    ``area`` names a column of the boxes' areas, where these are known better than from the corners, whose differences
    are rounded. Intersections no wider or no higher than ``least`` count as none.

    Each box has a level by its size: cells of a level are at least as wide as its boxes and less than twice as wide,
    so a box touches four cells of its level at most, and four of any higher one. A pair meets in the level of the
    larger box, in the cell that holds the corner of its intersection: no box is dealt to many cells, however unequal
    the sizes, and no pair is met twice. Crowded cells are the work of many tasks (``_crossed``). Boxes without an area, or with a side that is not finite, share none.
    """
    x, y = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    fine = (x > 0) & (y > 0) & (x < float("inf")) & (y < float("inf"))
    held = F.struct("x1", "y1", "x2", "y2", (N.box_area({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}) if area is None else F.col(area)).alias("area"))
    sized = boxes.where(fine).select(key, held.alias("box"), F.ceil(F.log2(F.greatest(x, y))).cast("int").alias("own"))
    # Sizes of doubles have about two thousand levels, so this row is small whatever the table.
    present = sized.agg(F.collect_set("own").alias("levels"))
    each = sized.crossJoin(F.broadcast(present)).select(key, "box", "own", F.explode(F.filter("levels", lambda v: v >= F.col("own"))).alias("level"))
    at = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    dealt = each.select(key, "box", "own", "level", F.explode(F.sequence(at(F.col("box.x1")), at(F.col("box.x2")))).alias("gx"))
    dealt = dealt.select("*", F.explode(F.sequence(at(F.col("box.y1")), at(F.col("box.y2")))).alias("gy"))
    # Used three times; a few rows a box.
    dealt = cut_lineage(dealt)
    met = _crossed(dealt.where("own = level"), dealt, key)
    corner = lambda k: at(F.greatest(F.col("p")[k], F.col("q")[k]))
    side = lambda i, j: F.least(F.col("p")[j], F.col("q")[j]) - F.greatest(F.col("p")[i], F.col("q")[i])
    wide = (side("x1", "x2") > least) & (side("y1", "y2") > least)
    met = met.where((corner("x1") == F.col("gx")) & (corner("y1") == F.col("gy")) & wide & (N.box_intersection(F.col("p"), F.col("q")) > 0))
    part = N.overlap_fraction(F.col("p"), F.col("q"), F.least("p.area", "q.area"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), part.alias("overlap"))


def registration_status(transformable: Column, same_crs: Column, overlap: Column, same_resolution: Column, aligned: Column) -> Column:
    """INVALID, VERIFIED, APPROXIMATE or UNKNOWN, the first that holds; nulls are unknown."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(no(~transformable) | no(overlap == 0), "INVALID")
        .when(no(same_crs) & no(same_resolution) & no(aligned), "VERIFIED")
        .when(no(transformable) & no(overlap > 0), "APPROXIMATE")
        .otherwise("UNKNOWN")
    )


def overall_status(transformable: Column, overlap: Column, reasons: Column) -> Column:
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.when(no(~transformable) | no(overlap == 0), "FAIL").when(F.size(reasons) > 0, "WARN").otherwise("PASS")


def reasons(**checks: Column) -> Column:
    """Names of all checks that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())), lambda x: x.isNotNull())


def aligned(t1: Column, t2: Column, tolerance: float = 1e-6) -> Column:
    """The second grid's origin lies a whole number of cells from the first's."""
    p = N.world_to_pixel(t1, t2["c"], t2["f"], 0.0)
    off = lambda x: F.abs(x - F.bround(x))
    return (off(p["col"]) <= tolerance) & (off(p["row"]) <= tolerance)


def endpoint_outcome(same_id: Column, same_asset: Column, overlap: Column, order_known: Column, order_matches: Column, same_type: Column, status: Column) -> Column:
    """The first policy that a pair breaks, by its code; null if it breaks none. Unknowns (nulls) break nothing but the order."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(same_id), "DUPLICATE_OBSERVATION")
        .when(yes(same_asset), "DUPLICATE_ASSET")
        .when(yes(overlap == 0), "NO_SPATIAL_OVERLAP")
        .when(yes(~order_matches), "TEMPORAL_ORDER_CONFLICT")
        .when(~yes(order_known), "TEMPORAL_ORDER_UNKNOWN")
        .when(yes(~same_type), "PAIR_TYPE_MISMATCH")
        .when(yes(status == "FAIL"), "PAIR_INCOMPATIBLE")
    )
