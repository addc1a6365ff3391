"""SimHash near-duplicates with bit-sliced comparison of fingerprints.

Fingerprint: lower-case A-Z, words [^\\x20\\x09-\\x0D]+, 3-word shingles with repeats (fewer words: the whole
sequence; none: fingerprint 0), XXH64 with seed 42, bit set if set in over half. Fingerprints link within
``RADIUS`` = 2 differing bits.

Candidates: of four bands of 16 bits, two fingerprints within two bits agree on two bands at least, so each distinct
fingerprint goes to six buckets and no link is lost. Buckets of over ``BLOCK`` fingerprints are split into blocks by
hash, and each pair of blocks is compared in a task of its own, so that no group grows with the data. Inside a
bucket the bit planes lie vertically (one integer per bit position, one lane per fingerprint); differences of all
lanes at one lane distance are counted at once by carry-save counters, and a distance is abandoned as soon as every
lane exceeds the radius. A bucket returns a spanning star of each of its components, never all its pairs.

Defined results: a null or blank text has fingerprint 0 and links like any other; equal rows link; a null doc_id
never is a component's name unless nothing else is there; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_copies
from .common import cut_lineage, fresh, places
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BANDS = 4
BLOCK = 1024
_PIECE = 1 << 16
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    if len(ws) < SHINGLE:
        return _hash(b" ".join(ws))
    n = len(ws) - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        part = ws[at : at + _PIECE + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE))))
        hashes = np.fromiter(map(_hash, shingles), np.uint64, len(part) - SHINGLE + 1)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` and the fingerprint ``out`` (long, the same 64 bits)."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            prints = np.array([fingerprint(t) for t in b.column(at).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints)], [*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def _stars(prints: list[np.ndarray]) -> list[tuple[int, int]]:
    """For many small buckets at once: (fingerprint, least fingerprint of its component) where they differ."""
    prints = sorted((np.unique(x) for x in prints), key=len, reverse=True)
    sizes = np.array([len(x) for x in prints])
    lanes = np.concatenate(prints)
    bucket = np.repeat(np.arange(len(prints)), sizes)
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = [int.from_bytes(np.packbits(bits[:, j], bitorder="little").tobytes(), "little") for j in range(64) if 0 < bits[:, j].sum() < len(lanes)]
    label = np.arange(len(lanes))
    ends = np.cumsum(sizes)
    for shift in range(1, int(sizes[0])):
        # Lanes of the buckets that have a pair at this distance; buckets are in order of size.
        n = int(ends[np.searchsorted(-sizes, -shift, "left") - 1])
        full = (1 << (n - shift)) - 1
        same = np.packbits(bucket[: n - shift] == bucket[shift:n], bitorder="little").tobytes()
        over = full & ~int.from_bytes(same, "little")
        ones = twos = 0
        for k, plane in enumerate(planes):
            differs = (plane ^ (plane >> shift)) & full
            carry = ones & differs
            ones ^= differs
            over |= twos & carry
            twos ^= carry
            over |= ones & twos
            if k % 4 == 3 and over == full:
                break
        if near := full & ~over:
            left = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))
            left = left[label[left] != label[left + shift]]
            while len(left):
                a, b = label[left], label[left + shift]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(label, label[label]):
                    label = label[label]
                left = left[label[left] != label[left + shift]]
    far = np.flatnonzero(label != np.arange(len(lanes)))
    return list(zip(lanes[far].tolist(), lanes[label[far]].tolist()))


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Star edges (u, v) that connect the same distinct fingerprints ``fp`` as all links within the radius do."""
    part = lambda i: F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(0xFFFF)
    chosen = [(i, j) for i in range(BANDS) for j in range(i + 1, BANDS)]
    keys = F.array(*(F.struct(F.lit(k).alias("k"), (part(i) * 65536 + part(j)).alias("key")) for k, (i, j) in enumerate(chosen)))
    dealt = prints.select("fp", F.explode(keys).alias("b")).select("fp", "b.k", "b.key")
    sizes = dealt.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rest = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (F.col("blocks") == 1) | (x != own))
    met = dealt.join(sizes, ["k", "key"]).select("fp", "k", "key", F.explode(rest).alias("other"), own.alias("own"))
    groups = met.groupBy("k", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def run(batches):
        for b in batches:
            rows, flat = b.column("fps").value_lengths().to_numpy(zero_copy_only=False), b.column("fps").flatten().to_numpy()
            parts = [x for x in np.split(flat, np.cumsum(rows)[:-1]) if len(x) > 1] if len(rows) else []
            # Lanes in steps, so that the planes stay small.
            step: list[np.ndarray] = []
            found: list[tuple[int, int]] = []
            for x in sorted(parts, key=len):
                step.append(x)
                if sum(map(len, step)) >= 1 << 14:
                    found += _stars(step)
                    step = []
            if step:
                found += _stars(step)
            yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return groups.select("fps").mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, [extra columns,] fp, component_id) for every row of ``docs``."""
    extra = extra or {}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(c.alias(k) for k, c in extra.items()))
    rows = cut_lineage(with_fingerprint(rows, "text", "fp").drop("text"))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fp"), block)).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", *extra, "fp", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near copies (``near_copies``; the fingerprints' radius is that of op9 alone): that of
    the smallest doc_id (equal rows, or rows of one doc_id with several texts in a class: one of them). Rows with a null doc_id stay only where their class has no other. The columns of ``docs``."""
    key, mark, rank, spot, hit = (fresh(docs, x) for x in ("_sh_text", "_sh_id", "_sh_rank", "_sh_place", "_sh_hit"))
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    found = cut_lineage(near_copies.classes(docs, th, doc_id, text))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("x"))
    keep = first.select(F.col("x.doc_id").alias(mark), F.col("x.th").alias(key))
    # Rows that go and rows that are there several times mark their places; a row at no marked place stays as it is. Only
    # the others move: the texts that stay are most, and joining them all would write them to disk twice.
    many = found.groupBy("doc_id", "th").agg(F.count("*").alias("n")).join(keep, F.col("doc_id").eqNullSafe(F.col(mark)) & (F.col("th") == F.col(key)), "left")
    marked = many.where((F.col("n") > 1) | F.col(key).isNull()).select(places(F.col("doc_id"), F.col("th")).alias(spot)).distinct()
    marked = cut_lineage(marked).withColumn(hit, F.lit(True))
    seen = docs.withColumn(key, th).withColumn(spot, places(F.col(doc_id), F.col(key))).join(F.broadcast(marked), spot, "left")
    alone = seen.where(F.col(hit).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
    joined = seen.where(F.col(hit)).join(keep, key).where(F.col(doc_id).eqNullSafe(F.col(mark)))
    one = W.partitionBy(key, mark).orderBy(key)
    rest = joined.withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
    return alone.union(rest)
