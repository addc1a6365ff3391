"""Exact percentiles and running sums of groups that no single task can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage

#: A bracket holds about this share of a group's values after one pass; two passes leave the square of it.
ACCURACY = 2000
#: Values of a bracket that one task may sort.
FEW = 1 << 20
_PASSES = 4


def percentiles(tiles: DataFrame, keys: list[str], ranks: tuple[float, ...], data: str = "data", accuracy: int = ACCURACY, few: int = FEW) -> DataFrame:
    """``keys``, valid, cells, min, max and ``p``: the exact percentiles (linear between neighbours) of the cells of all tiles of a key.

    tiles: ``keys`` and an array of doubles, null where masked. Each pass refines brackets around the wanted ranks: a
    mergeable sketch of what is inside (some thousand values a group) proposes a narrower bracket, and the next pass
    counts what is below and inside it; a bracket that proves not to hold its rank is given up for the one before. Once
    no bracket holds more than ``few`` values, these are counted by value and the ranks are read off. Tiles are read
    once a pass and never moved by cell; only values inside the last brackets are shuffled. Defined results: a key
    without valid cells has null figures; ties and infinite values count as they are; NaN cells count as masked.
    """
    rows = tiles.select(*keys, F.filter(data, lambda v: v.isNotNull() & ~F.isnan(v)).alias("v"), F.size(data).alias("c"))
    whole = cut_lineage(rows.groupBy(*keys).agg(F.sum("c").alias("cells"), F.sum(F.size("v")).alias("valid"), F.min(F.array_min("v")).alias("min"), F.max(F.array_max("v")).alias("max")))
    wanted = F.array(*(F.struct(F.lit(float(q)).alias("q")) for q in ranks))
    place = lambda q: q * (F.col("valid") - 1)
    # A bracket for each of the two neighbours of a rank; equal ones are kept once.
    both = F.array_distinct(F.flatten(F.transform(wanted, lambda w: F.array(F.floor(place(w["q"])), F.ceil(place(w["q"]))))))
    first = F.transform(both, lambda r: F.struct(r.alias("r"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("valid").alias("inside")))
    state = cut_lineage(whole.where("valid > 0").select(*keys, first.alias("b")))
    for _ in range(_PASSES):
        open_ = state.select(*keys, F.explode("b").alias("b")).select(*keys, "b.*")
        if not open_.where((F.col("inside") > few) & (F.col("lo") < F.col("hi"))).limit(1).count():
            break
        # What a sketch of the bracket's values proposes: a margin of two of its errors on both sides of the rank.
        inside = rows.join(state, keys).select(*keys, "v", F.explode(F.filter("b", lambda b: (b["inside"] > few) & (b["lo"] < b["hi"]))).alias("b"))
        values = inside.select(*keys, "b", F.explode(F.filter("v", lambda v: (v >= F.col("b.lo")) & (v <= F.col("b.hi")))).alias("x"))
        steps = F.array(*(F.lit(i / (accuracy // 4)) for i in range(accuracy // 4 + 1)))
        sketch = values.groupBy(*keys, "b").agg(F.percentile_approx("x", steps, accuracy).alias("s"))
        share = (F.col("b.r") - F.col("b.below")) / F.col("b.inside")
        at = lambda move: F.get("s", F.greatest(F.lit(0), F.least(F.lit(accuracy // 4), (F.floor(share * (accuracy // 4)) + move).cast("int"))))
        proposed = sketch.select(*keys, F.col("b.r").alias("r"), at(-1).alias("lo"), at(2).alias("hi"))
        proposed = cut_lineage(proposed.groupBy(*keys).agg(F.collect_list(F.struct("r", "lo", "hi")).alias("n")))
        # Counted on the tiles' own arrays.
        count = lambda n: F.struct(n["r"].alias("r"), F.size(F.filter("v", lambda v: v < n["lo"])).cast("long").alias("below"), F.size(F.filter("v", lambda v: (v >= n["lo"]) & (v <= n["hi"]))).cast("long").alias("inside"))
        counted = rows.join(proposed, keys).select(*keys, F.explode(F.transform("n", count)).alias("c")).groupBy(*keys, F.col("c.r").alias("r")).agg(F.sum("c.below").alias("below"), F.sum("c.inside").alias("inside"))
        fresh = proposed.select(*keys, F.explode("n").alias("n")).select(*keys, "n.*").join(counted, [*keys, "r"])
        fresh = fresh.select(*keys, "r", F.struct("lo", "hi", "below", "inside").alias("new")).where((F.col("new.below") <= F.col("r")) & (F.col("r") < F.col("new.below") + F.col("new.inside")))
        old = open_.select(*keys, "r", F.struct("lo", "hi", "below", "inside").alias("old"))
        taken = old.join(fresh, [*keys, "r"], "left").select(*keys, "r", F.coalesce("new", "old").alias("x")).select(*keys, "r", "x.*")
        state = cut_lineage(taken.groupBy(*keys).agg(F.collect_list(F.struct("r", "lo", "hi", "below", "inside")).alias("b")))
    # Of a bracket of one value, that value; of the others, the value at the rank, by counts of values.
    held = rows.join(state, keys).select(*keys, "v", F.explode(F.filter("b", lambda b: b["lo"] < b["hi"])).alias("b"))
    values = held.select(*keys, F.col("b.r").alias("r"), F.col("b.below").alias("below"), F.explode(F.filter("v", lambda v: (v >= F.col("b.lo")) & (v <= F.col("b.hi")))).alias("x"))
    counts = values.groupBy(*keys, "r", "below", "x").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(W.partitionBy(*keys, "r").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))
    read = counts.withColumn("upto", upto).where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n"))).select(*keys, "r", "x")
    single = state.select(*keys, F.explode(F.filter("b", lambda b: b["lo"] >= b["hi"])).alias("b")).select(*keys, F.col("b.r").alias("r"), F.col("b.lo").alias("x"))
    found = read.union(single).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("x"))
    value = lambda q: F.element_at("x", F.floor(place(q))) + (place(q) - F.floor(place(q))) * (F.element_at("x", F.ceil(place(q))) - F.element_at("x", F.floor(place(q))))
    exact = lambda q: F.when(F.floor(place(q)) == F.ceil(place(q)), F.element_at("x", F.floor(place(q)))).otherwise(value(q))
    return whole.join(found, keys, "left").select(*keys, "valid", "cells", "min", "max", F.when(F.col("x").isNotNull(), F.transform(wanted, lambda w: exact(w["q"]))).alias("p"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums ``sums`` (name: value) over the whole table in an order, in several tasks.

    Rows are cut into ranges of the order by sampled cut points, each range is summed, and the sums of the ranges before
    (as many rows as ranges, whatever the table) are added to the running sums inside a range. Rows that the order does
    not tell apart stay in one range, in any order: make it total.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *(c.alias(f"_v_{k}") for k, c in sums.items()))
    # Written down, as the cut points are drawn anew each time that they are asked for.
    cut = cut_lineage(keyed.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    totals = cut.groupBy("_range").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # One row a range: not more than there are partitions.
    met = cut.join(F.broadcast(offsets), "_range")
    return met.select(*df.columns, *((F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) + F.col(f"_o_{k}")).alias(k) for k in sums))


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in a total order of the whole table, in several tasks."""
    return running(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)
