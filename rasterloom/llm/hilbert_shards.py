"""Sharding in Hilbert-curve order, so that files are compact in several metadata dimensions at once.

Each dimension is quantised to ``BITS`` bits by quantiles of the rows: a value's step is the number of cut points below it,
and cut points are values at even shares of the rows, so that frequent values get steps of their own. Numbers and dates
count as they are; strings by the seven bytes that follow what all of them begin with (as numbers, which keeps their
order). Cells are visited along the Hilbert curve, and the run of all rows is cut into shards whose row counts are at
most one apart (law ``rows``). Within a cell rows stand in the order of a hash of id, size, text and place in the input.

Plan: ids and figures, never texts, are checkpointed once with their place; two histograms, by cell and by (cell, range
of the hash), give each range its first rank; a cell of very many rows is cut into as many ranges as it takes to have
about a quarter of a partition's rows each, whatever ids or texts repeat. Then rows are ranked within their range: the
one shuffle. Driver and broadcast see at most 2^(BITS * dimensions) cells plus four ranges for each shuffle partition.

Defined results: null dimensions have step 0; a null text has no bytes, size 1 and the CRC of no bytes;
rows with a null id, equal ids or equal rows get a slot each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, fresh, shuffle_partitions

BITS = 4
SHARDS = 8
DIMENSIONS = ("lang", "source", "n_chars")


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index along the curve of points (one row each), by the transposed-axes method."""
    x = axes.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swapped = (x[0] ^ x[i]) & p
            first = np.where(high, x[0] ^ p, x[0] ^ swapped)
            x[i] = np.where(high, x[i], x[i] ^ swapped) if i else first
            x[0] = first
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _codes(docs: DataFrame, dimensions) -> list[Column]:
    """Each dimension as a number that keeps its order."""
    kinds = {d: docs.schema[d].dataType for d in dimensions}
    plain = [d for d in dimensions if not isinstance(kinds[d], (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    raw = {d: F.col(f"`{d}`").cast("string").cast("binary") for d in plain}
    ends = docs.agg(F.count("*"), *(f(raw[d]).alias(f"{k}{i}") for i, d in enumerate(plain) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    out = []
    for d in dimensions:
        c = F.col(f"`{d}`")
        if d not in plain:
            out.append(c.cast("double") if isinstance(kinds[d], T.NumericType) else F.datediff(c, F.lit("1970-01-01")).cast("double"))
            continue
        lo, hi = (bytes(ends[f"{k}{plain.index(d)}"] or b"") for k in ("lo", "hi"))
        # What the least and the greatest begin with, all do.
        common = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
        head = F.rpad(F.hex(F.substring(raw[d], common + 1, 7)), 14, "0")
        out.append(F.conv(head, 16, 10).cast("double"))
    return out


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dimensions=DIMENSIONS, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for each row of ``docs``; curve: its cell's place on the curve."""
    spark = docs.sparkSession
    codes = _codes(docs, dimensions)
    steps = 1 << bits
    shares = F.array(*(F.lit(k / steps) for k in range(1, steps)))
    quantiles = docs.agg(F.count("*").alias("n"), *(F.percentile_approx(c, shares, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(codes))).first()
    total = quantiles["n"]

    def step(i: int) -> Column:
        cuts = sorted(set(quantiles[f"q{i}"] or ()))
        return F.coalesce(sum(((codes[i] > F.lit(c)).cast("int") for c in cuts), F.lit(0)), F.lit(0))

    cell = sum((step(i) * (1 << (bits * i)) for i in range(1, len(codes))), step(0)).cast("int")
    content = F.coalesce(F.col(text), F.lit(""))
    figures = docs.select(F.col(doc_id).alias("doc_id"), cell.alias("cell"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    rows = cut_lineage(figures.withColumn("own", F.xxhash64("doc_id", "size", "text_crc32", "place").bitwiseAND((1 << 32) - 1)))
    counts = rows.groupBy("cell").count().collect()
    # Ranges of the hash for each cell, as many as its rows call for.
    each = max(1.0, total / (4 * shuffle_partitions(spark)))
    ranges = spark.createDataFrame([(r["cell"], int(np.ceil(r["count"] / each))) for r in counts], "cell int, ranges int")
    part = (F.col("own") * F.col("ranges")).bitwiseAND(-(1 << 32)) / (1 << 32)
    dealt = rows.join(F.broadcast(ranges), "cell").withColumn("part", part.cast("int"))
    sizes = dealt.groupBy("cell", "part").count().collect()
    axes = np.array([[(r["cell"] >> (bits * i)) & (steps - 1) for i in range(len(codes))] for r in sizes], np.int64).reshape(len(sizes), len(codes))
    ordered = sorted(zip(hilbert_index(axes, bits).tolist(), (r["part"] for r in sizes), (r["cell"] for r in sizes), (r["count"] for r in sizes)))
    firsts, at = [], 0
    for curve, p, c, n in ordered:
        firsts.append((c, p, at, curve))
        at += n
    offsets = spark.createDataFrame(firsts, "cell int, part int, first long, curve long")
    within = F.row_number().over(W.partitionBy("cell", "part").orderBy("own", "doc_id", "text_crc32", "place"))
    ranked = dealt.withColumn("within", within).join(F.broadcast(offsets), ["cell", "part"]).withColumn("rank", F.col("first") + F.col("within") - 1)
    shard = F.expr(f"(rank * {shards}L) div {max(total, 1)}L").cast("int")
    slot = F.expr(f"rank - ((shard * {total}L + {shards - 1}L) div {shards}L)")
    return ranked.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", **options) -> None:
    """Writes ``docs`` (unique ids) as Parquet, partitioned by shard; each file holds a run of slots, so its statistics prune."""
    placed = assign(docs, doc_id, **options).select(F.col("doc_id").alias(key := fresh(docs, "_shard_id")), "shard", "slot")
    n = shuffle_partitions(docs.sparkSession)
    joined = docs.join(placed, F.col(doc_id).eqNullSafe(F.col(key))).drop(key)
    joined.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
