"""Hard negatives by norm-bucketed search: exact inner products, with buckets pruned by the Cauchy-Schwarz bound.

Vectors are rows of whole numbers. ``search`` returns for each window of an anchor (its label, a least and a greatest
score) the first k candidates of the same or of another label. Candidates are dealt over stripes by hash, and sorted in
each by norm, greatest first; runs of ``BUCKET`` of them are a bucket, whose greatest norm is its first row's. Anchors
are cut into blocks, and a block meets each of its stripes in one stream: anchors first, then bucket after bucket. For
each window the stream keeps its first k so far. A window takes no part in a bucket where |anchor| * (greatest norm of
the bucket) is below the window's least score or its running kth score; when no window is left, the rest of the stripe
is passed over. A last window over (anchor, window) takes the first k of the stripes' firsts. The bound is strict, so
equal scores of smaller ids are not lost. On unit vectors norms tell nothing, and every bucket is read; the search is
exact whatever the norms.

What moves: candidates once a block of ``ANCHORS`` anchors; anchors once a stripe, of which there are as many as give
each partition one block and stripe; k rows a window and stripe. A task holds one block of anchors, one Arrow batch of
candidates and one bucket's scores, whatever the size of the table or of a label.

Sums are exact: in doubles while no partial sum can reach 2^53, else in Python's integers. A score beyond 64 bits is
an error.

Defined results: rows with a null label or vector, or with a null or non-finite component, take no part; a shorter
vector counts as filled up with zeros; rows with the anchor's id are not others, all other repeated rows count each;
ties go by id, a null id last (and it is no anchor); an anchor without positives, or a positive without negatives in
its window, gives no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions

BUCKET = 256
ANCHORS = 2048
POSITIVES = 5
NEGATIVES = 10
# Window limits in hundredths of the positive's score.
LOW, HIGH = 30, 90
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_NULL_ID = np.iinfo(np.int64).max


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles (whole numbers); null if the vector or a component is null or not finite."""
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < inf))
    # A double floor: the built-in one goes through 64-bit integers.
    return F.when(fine, F.transform(vector, lambda x: F.when(F.abs(x) < float(1 << 44), F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale)))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as a matrix, shorter rows filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0))
    data = np.zeros((len(sizes), dim))
    data[np.arange(dim)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return data


class _Firsts:
    """The first k (greatest score, then least id) of each window so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LEAST, np.int64)
        self.id = np.full((n, k), _NULL_ID, np.int64)
        self.found = np.zeros(n, np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach to count: the running kth, or anything where fewer are found."""
        return np.where(self.found >= self.k, self.score[:, -1], _LEAST)

    def add(self, window: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(window):
            return
        touched, row = np.unique(window, return_inverse=True)
        had = np.arange(self.k)[None, :] < self.found[touched][:, None]
        row = np.concatenate([np.repeat(np.arange(len(touched)), had.sum(axis=1)), row])
        score = np.concatenate([self.score[touched][had], score])
        ident = np.concatenate([self.id[touched][had], ident])
        order = np.lexsort((ident, ~score, row))
        row, score, ident = row[order], score[order], ident[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        row, place = row[keep], place[keep]
        self.score[touched[row], place], self.id[touched[row], place] = score[keep], ident[keep]
        self.found[touched] = np.bincount(row, minlength=len(touched))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(d, 1)
    if most < float(1 << 53):
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a.tolist()], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b.tolist()], object).reshape(b.shape).T
    if any(abs(x) > _MOST for x in exact.ravel().tolist()):
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


class _Block:
    """A block of anchors with their windows, against one stripe."""

    def __init__(self, rows: pa.Table, k: int, same: bool):
        self.ids, self.key, self.label = (rows.column(c).to_numpy().astype(np.int64) for c in ("id", "key", "label"))
        self.data = _matrix(rows.column("vector").combine_chunks())
        self.norm = np.sqrt((self.data**2).sum(axis=1))
        low, high = (rows.column(c).combine_chunks() for c in ("low", "high"))
        sizes = low.value_lengths().to_numpy(zero_copy_only=False)
        self.anchor = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.anchor)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.low, self.high = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (low, high))
        self.firsts = _Firsts(len(self.low), k)
        self.same, self.done = same, not len(self.low)

    def meet(self, norms: np.ndarray, ids: np.ndarray, label: np.ndarray, data: np.ndarray) -> None:
        """Candidates by falling norm, in buckets."""
        for at in range(0, len(ids), BUCKET):
            if self.done:
                return
            need = np.maximum(self.low, self.firsts.least())
            # A little above the bound, for its rounding.
            alive = np.flatnonzero(self.norm[self.anchor] * norms[at] * (1 + 1e-9) >= need)
            if not len(alive):
                self.done = True
                return
            part = slice(at, at + BUCKET)
            rows, row = np.unique(self.anchor[alive], return_inverse=True)
            score = _scores(self.data[rows], data[part])
            fits = (self.label[rows][:, None] == label[part][None, :]) == self.same
            fits &= self.ids[rows][:, None] != ids[part][None, :]
            for i in range(int(self.place[alive].max()) + 1):
                here = self.place[alive] == i
                w, r = alive[here], row[here]
                got = score[r]
                x, y = np.nonzero(fits[r] & (got >= need[w][:, None]) & (got <= self.high[w][:, None]))
                self.firsts.add(w[x], got[x, y], ids[part][y])

    def result(self) -> pa.RecordBatch:
        x, y = np.nonzero(np.arange(self.firsts.k)[None, :] < self.firsts.found[:, None])
        ids = self.firsts.id[x, y]
        return pa.RecordBatch.from_pydict(
            {"key": pa.array(self.key[self.anchor[x]]), "window": pa.array(self.place[x], pa.int32()), "id": pa.array(ids, pa.int64(), mask=ids == _NULL_ID), "score": pa.array(self.firsts.score[x, y], pa.int64())}
        )


def search(anchors: DataFrame, candidates: DataFrame, k: int, same: bool) -> DataFrame:
    """(key, window, id, score, rank) of the first ``k`` candidates of each window.

    anchors: key (a long, its own for each row), id, label, vector, low and high (arrays, one entry a window);
    candidates: id, label, vector; same: whether candidates have the anchor's label, or another one.
    """
    parts = shuffle_partitions(anchors.sparkSession)
    blocks = -(-max(1, anchors.count()) // ANCHORS)
    stripes = -(-parts // blocks)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    left = anchors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("stripe", each(stripes))
    left = left.select("block", "stripe", none("double").alias("norm"), "key", "id", "label", "vector", "low", "high")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    right = candidates.withColumn("norm", norm).withColumn("stripe", F.pmod(F.xxhash64("id", "norm"), F.lit(stripes)).cast("int")).withColumn("block", each(blocks))
    right = right.select("block", "stripe", "norm", none("long").alias("key"), "id", "label", "vector", none("array<long>").alias("low"), none("array<long>").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]):
        at, waiting, block = None, [], None
        for b in batches:
            place = b.column("block").to_numpy().astype(np.int64) * stripes + b.column("stripe").to_numpy()
            candidate = b.column("norm").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (candidate[1:] != candidate[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                if place[lo] != at:
                    if waiting:
                        yield (block or _Block(pa.Table.from_batches(waiting), k, same)).result()
                    at, waiting, block = place[lo], [], None
                part = b.slice(lo, hi - lo)
                if not candidate[lo]:
                    waiting.append(part)
                elif waiting:
                    block = block or _Block(pa.Table.from_batches(waiting), k, same)
                    if not block.done:
                        ids = part.column("id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
                        block.meet(part.column("norm").to_numpy(), ids, part.column("label").to_numpy(), _matrix(part.column("vector")))
        if waiting:
            yield (block or _Block(pa.Table.from_batches(waiting), k, same)).result()

    # Anchors (without a norm) come first, then candidates by falling norm.
    met = left.union(right).repartition(parts, "block", "stripe").sortWithinPartitions("block", "stripe", F.col("norm").desc_nulls_first())
    firsts = met.mapInArrow(run, "key long, window int, id long, score long")
    order = W.partitionBy("key", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return firsts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (id, label, vector) that ``anchor`` chooses.

    A negative has another label and low % to high % of the positive's score."""
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where("label is not null and vector is not null")
    rows = cut_lineage(rows)
    anchors = cut_lineage(rows.where(anchor & F.col("id").isNotNull()).withColumn("key", F.monotonically_increasing_id()))
    whole_range = anchors.withColumn("low", F.array(F.lit(_LEAST))).withColumn("high", F.array(F.lit(_MOST)))
    found = search(whole_range, rows, positives, True).where(F.col("score") >= 0)
    # Floor and ceiling of hundredths, in decimals so that no score overflows.
    part = lambda x, p: (x.cast("decimal(20,0)") * p)
    windows = F.transform("positives", lambda p: F.struct(F.ceil(part(p["score"], low) / 100).cast("long").alias("low"), F.floor(part(p["score"], high) / 100).cast("long").alias("high")))
    chosen = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    chosen = cut_lineage(anchors.join(chosen, "key").withColumn("w", windows).select("key", "id", "label", "vector", "positives", F.col("w.low").alias("low"), F.col("w.high").alias("high")))
    got = search(chosen.drop("positives"), rows, negatives, False).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    named = got.join(chosen.select("key", F.col("id").alias("anchor_id"), "positives"), "key").withColumn("p", F.get("positives", F.col("window")))
    return named.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p.score").alias("positive_score"), "negative_score")
