"""Substring deduplication: words covered by a window of ``WINDOW`` words that also starts in a document of smaller id.

Words are [^\\x20\\x09-\\x0D]+, unchanged. The matching is backward search in a compressed FM-index per shard.

1. Texts. Equal texts (128-bit hash) are one text, owned by their smallest id; in all other copies every window starts
   in the owner too, so they need no search.
2. Shards. A window's anchor is its ``GRAM``-word sequence of least hash, leftmost first; equal windows have equal
   anchors. Neighbouring windows share anchors, about one for 21 words. Anchors met under one owner only are dropped
   (a count of hashes); runs of windows with one of the others become segments, each with its anchor's key. Equal
   segments are one, with their smallest owner. Shards are of many keys, some ``SHARD`` segments each.
3. Search. Each shard's segments are indexed (``fm_index``) and streamed through the index from their ends; matches of
   50 words are followed, and report the runs of windows whose suffix interval holds a smaller owner.
4. Very frequent keys. A key of over ``HOT`` different segments does not fit a shard. Its segments are cut into blocks
   of ``WIDTHS`` windows at places counted from the anchor, and keyed anew by the words that all windows of the block
   share, so equal windows meet again; equal pieces are one again. Blocks of one window need no search: equal windows
   are one piece. No key is dropped or capped.

What moves: anchors once a text (8 bytes for 21 words), segments of shared anchors, texts twice (to cut segments, and
to cut out what is found). Each row of a copied text is joined with its text by hash; Spark's adaptive joins split such
a group of rows. Shards have a bounded number of segments, each of at most 2 ``WINDOW`` words.

Defined results: null, blank and short texts have no window and stay; rows with a null id stay and remove nothing;
rows of one id do not remove each other's words, nor does a text its own; equal rows have equal results; very long
texts are searched whole; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, discard, fresh, written
from .fm_index import Index
from .tokens import Hashes, hashed, slices

WINDOW = 50
GRAM = 10
SHARD = 2048
HOT = 2048
#: Windows in a block, from one level of frequent keys to the next.
WIDTHS = (7, 1)
_SPAN = WINDOW - GRAM + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "array<struct<lo:int,hi:int>>"


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash for the ``GRAM`` words from each place on."""
    n = len(ids) - GRAM + 1
    h = ids[:n].copy()
    for k in range(1, GRAM):
        h ^= h >> np.uint64(29)
        h *= _MIX
        h += ids[k : k + n]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``span`` values in a row, and where the leftmost one is."""
    at, wide = np.arange(len(values)), 1
    while wide < span:
        step = min(wide, span - wide)
        right = values[step:] < values[:-step]
        values, at = np.where(right, values[step:], values[:-step]), np.where(right, at[step:], at[:-step])
        wide += step
    return values, at


def anchors(words: list[list[bytes]], memo: Hashes) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first window, last window, anchor's place, key."""
    ids, begin = hashed(words, memo)
    if len(ids) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    key, at = _least(_grams(ids), _SPAN)
    text = np.repeat(np.arange(len(words)), np.diff(begin))[: len(at)]
    whole = np.flatnonzero(np.arange(len(at)) + WINDOW <= begin[1:][text])
    key, at, text = key[whole], at[whole], text[whole]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])) if len(whole) else whole
    last = np.append(first[1:], len(whole))[: len(first)] - 1
    own = begin[:-1][text[first]]
    return text[first], whole[first] - own, whole[last] - own, at[first] - own, key[first].view(np.int64)


def _lists(values: np.ndarray, row: np.ndarray, n: int, kind) -> pa.Array:
    """Values by row (in order) as lists of n rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_t1, _t2, _owner (the row's id) and _text."""
    t1, t2 = text_hash(F.col(text))
    return docs.select(t1.alias("_t1"), t2.alias("_t2"), F.col(doc_id).alias("_owner"), F.col(text).alias("_text"))


def text_hash(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def _texts(rows: DataFrame) -> DataFrame:
    """(_t1, _t2, _owner, keys): different texts that have a window, their smallest id and the keys of their anchors."""
    kind = rows.schema["_owner"].dataType

    def run(batches):
        memo = Hashes()
        for b in batches:
            for at, texts in slices(b.column(3), 1 << 20):
                text, *_, key = anchors([t.split() for t in texts], memo)
                some, row = np.unique(text, return_inverse=True)
                if len(some):
                    part = b.select([0, 1, 2]).take(pa.array(at + some))
                    yield pa.RecordBatch.from_arrays([*part.columns, _lists(key, row, len(some), pa.int64())], ["_t1", "_t2", "_owner", "keys"])

    found = rows.where("_owner is not null").mapInArrow(run, T.StructType([T.StructField("_t1", T.LongType()), T.StructField("_t2", T.LongType()), T.StructField("_owner", kind), T.StructField("keys", T.ArrayType(T.LongType()))]))
    return found.groupBy("_t1", "_t2").agg(F.min("_owner").alias("_owner"), F.first("keys").alias("keys"))


def _segments(rows: DataFrame) -> DataFrame:
    """Segments of the texts: _t1, _t2, _owner, lo (first window), n (windows), key, place (the anchor's, in the segment), words."""
    schema = T.StructType([*rows.schema.fields[:3], *(T.StructField(c, k) for c, k in (("lo", T.IntegerType()), ("n", T.IntegerType()), ("key", T.LongType()), ("place", T.IntegerType()), ("words", T.StringType())))])

    def run(batches):
        memo = Hashes()
        for b in batches:
            for at, texts in slices(b.column(3), 1 << 20):
                words = [t.split() for t in texts]
                text, first, last, place, key = anchors(words, memo)
                asked = b.column(4).slice(at, len(texts))
                sizes = asked.value_lengths().to_numpy(zero_copy_only=False)
                pairs = np.stack([np.repeat(np.arange(len(texts)), sizes), asked.flatten().to_numpy(zero_copy_only=False)]) if len(texts) else np.zeros((2, 0), np.int64)
                have = set(zip(*pairs.tolist()))
                keep = np.array([p in have for p in zip(text.tolist(), key.tolist())], bool)
                text, first, last, place, key = text[keep], first[keep], last[keep], place[keep], key[keep]
                cut = [b" ".join(words[t][f : e + WINDOW]) for t, f, e in zip(text.tolist(), first.tolist(), last.tolist())]
                part = b.select([0, 1, 2]).take(pa.array(at + text))
                more = (pa.array(first, pa.int32()), pa.array(last - first + 1, pa.int32()), pa.array(key, pa.int64()), pa.array(place - first, pa.int32()), pa.array(cut, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema.names)

    return rows.mapInArrow(run, schema)


def _different(pieces: DataFrame) -> DataFrame:
    """Equal pieces (c1, c2) of a key as one, with their smallest owner."""
    return pieces.groupBy("key", "c1", "c2").agg(F.min("_owner").alias("_owner"), F.first("place").alias("place"), F.first("words").alias("words"))


def _hash2(column: str) -> list[Column]:
    return [F.xxhash64(column).alias("c1"), F.xxhash64(F.lit("second"), column).alias("c2")]


def _searched(shard: pa.Table) -> pa.Table:
    """For the segments of one shard: the runs of windows that start under a smaller owner too, where there are any."""
    words = [w.split(b" ") for w in shard.column("words").cast(pa.binary()).to_pylist()]
    begin = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    known: dict[bytes, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for ws in words for w in ws], np.int64)
    # Owners by rank, so that any type of id will do.
    order = shard.column("_owner").combine_chunks()
    rank = np.searchsorted(*(np.unique(order.to_numpy(zero_copy_only=False), return_inverse=False), order.to_numpy(zero_copy_only=False)))
    index = Index(flat, begin, WINDOW)
    piece, place, low, high = index.matches(flat, begin)
    # Intervals of one depth are equal or apart.
    starts, which = np.unique(low, return_inverse=True)
    ends = np.zeros(len(starts), np.int64)
    ends[which] = high
    owners = np.append(rank[index.owner[index.order]], 0)
    least = np.minimum.reduceat(owners, np.stack([starts, ends], 1).ravel())[::2] if len(starts) else starts
    hit = np.flatnonzero(least[which] < rank[piece])
    hit = hit[np.lexsort((place[hit], piece[hit]))]
    piece, place = piece[hit], place[hit]
    new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)])[: len(hit)]
    lo, hi = place[new], place[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else place
    some, row = np.unique(piece[new], return_inverse=True)
    runs = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["lo", "hi"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(some)))]).astype(np.int32)
    return pa.table({"c1": shard.column("c1").take(pa.array(some)), "c2": shard.column("c2").take(pa.array(some)), "runs": pa.ListArray.from_arrays(pa.array(ends), runs)})


def _blocks(pieces: DataFrame, width: int) -> DataFrame:
    """Pieces in blocks of ``width`` windows from the anchor on, keyed by the words that a block's windows share."""
    w = F.split("words", " ")
    # Windows by their distance to the anchor: 0 is the one that ends with it.
    far = (F.lit(_SPAN - 1) - F.col("place")).cast("int")
    n = F.size(w) - WINDOW + 1
    cut = pieces.select("*", w.alias("w"), far.alias("far"), n.alias("n")).select("*", F.explode(F.sequence(F.expr(f"far div {width}"), F.expr(f"(far + n - 1) div {width}"))).alias("block"))
    first, last = F.greatest(F.lit(0), F.col("block") * width - F.col("far")), F.least(F.col("n") - 1, (F.col("block") + 1) * width - 1 - F.col("far"))
    core = F.slice("w", (F.col("block") + 1) * width - F.col("far"), F.lit(WINDOW - width + 1))
    cut = cut.select("c1", "c2", "_owner", first.cast("int").alias("lo"), (last - first + 1).cast("int").alias("n"), F.xxhash64("key", "block", F.array_join(core, " ")).alias("key"), (F.col("place") - first).cast("int").alias("place"), F.array_join(F.slice("w", (first + 1).cast("int"), (last - first + WINDOW).cast("int")), " ").alias("words"))
    return cut.select(F.col("c1").alias("p1"), F.col("c2").alias("p2"), "_owner", "lo", "n", "key", "place", "words", *_hash2("words"))


def _runs(places: DataFrame, pieces: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and runs: what is found for different pieces, told to the places (_owner, lo, n, key, c1, c2) that hold them."""
    least = pieces.select("key", "c1", "c2", F.col("_owner").alias("_least"))
    told = places.join(least, ["key", "c1", "c2"]).join(found, ["c1", "c2"], "left")
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi")))
    runs = F.when(F.col("_owner") > F.col("_least"), whole).otherwise(F.col("runs")).cast(_RUNS)
    shifted = F.transform(runs, lambda r: F.struct((r["lo"] + F.col("lo")).alias("lo"), (r["hi"] + F.col("lo")).alias("hi")))
    return told.select(*by, shifted.alias("runs")).where("runs is not null").groupBy(*by).agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _resolve(pieces: DataFrame, hot: int, shard: int, widths: tuple[int, ...]) -> DataFrame:
    """(c1, c2, runs) of the different pieces: the windows that start under a smaller owner too."""
    sizes = cut_lineage(pieces.groupBy("key").agg(F.count("*").alias("size")))
    most, total = sizes.agg(F.max("size"), F.sum(F.when(F.col("size") <= hot, F.col("size")))).first()
    # A key of one piece has nothing to be compared with.
    cold = pieces.join(sizes.where(F.col("size").between(2, hot)), "key")
    shards = max(1, -(-(total or 0) // shard))
    found = cold.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).select("shard", "c1", "c2", "_owner", "words")
    found = found.groupBy("shard").applyInArrow(_searched, f"c1 long, c2 long, runs {_RUNS}")
    if (most or 0) > hot and widths:
        parts = cut_lineage(_blocks(pieces.join(sizes.where(F.col("size") > hot), "key"), widths[0]))
        fewer = cut_lineage(_different(parts))
        empty = fewer.select("c1", "c2", F.lit(None).cast(_RUNS).alias("runs")).where("false")
        inner = _resolve(fewer, hot, shard, widths[1:]) if len(widths) > 1 else empty
        found = found.union(_runs(parts, fewer, inner, ["p1", "p2"]))
    return cut_lineage(found)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "repeats", hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """``docs`` and ``out``: struct(n_words, n_removed, kept), kept being the words left, joined by one space."""
    spark = docs.sparkSession
    rows = _keyed(docs, doc_id, text)
    texts = cut_lineage(_texts(rows))
    dealt = texts.select("_t1", "_t2", "_owner", F.explode(F.array_distinct("keys")).alias("key"))
    shared = dealt.groupBy("key").agg(F.min("_owner").alias("a"), F.max("_owner").alias("b")).where("a < b").select("key")
    wanted = dealt.join(shared, "key").groupBy("_t1", "_t2", "_owner").agg(F.collect_list("key").alias("keys"))
    segments, path = written(_segments(rows.join(wanted, ["_t1", "_t2", "_owner"]).select("_t1", "_t2", "_owner", "_text", "keys")).select("*", *_hash2("words")), "segments")
    pieces = cut_lineage(_different(segments))
    runs = cut_lineage(_runs(segments.drop("words"), pieces, _resolve(pieces, hot, shard, WIDTHS), ["_t1", "_t2"]))
    discard(spark, path)
    known = texts.select("_t1", "_t2", "_owner").join(runs, ["_t1", "_t2"], "left")
    names = {c: fresh(docs, c) for c in ("_t1", "_t2", "_owner", "runs")}
    known = known.select(*(F.col(c).alias(n) for c, n in names.items()))
    t1, t2 = text_hash(F.col(f"`{text}`"))
    n1, n2, owner, held = names.values()
    joined = docs.select("*", t1.alias(n1), t2.alias(n2)).join(known, [n1, n2], "left").select(*(F.col(f"`{c}`") for c in docs.columns), F.when(F.col(f"`{doc_id}`") > F.col(owner), True).otherwise(False).alias(n1), F.when(F.col(f"`{doc_id}`") == F.col(owner), F.col(held)).alias(held))
    return _cut(joined, docs, text, out)


def _cut(joined: DataFrame, docs: DataFrame, text: str, out: str) -> DataFrame:
    at, n = docs.columns.index(text), len(docs.columns)

    def run(batches):
        for b in batches:
            for first, texts in slices(b.column(at), 1 << 21):
                part = b.slice(first, len(texts))
                total, gone, kept = [], [], []
                for t, copy, runs in zip(texts, part.column(n).to_pylist(), part.column(n + 1).to_pylist()):
                    words = t.split()
                    total.append(len(words))
                    if copy:
                        words = []
                    elif runs:
                        lost = np.zeros(len(words) + 1, np.int64)
                        ends = np.array([(r["lo"], r["hi"] + WINDOW) for r in runs])
                        np.add.at(lost, ends[:, 0], 1)
                        np.add.at(lost, ends[:, 1], -1)
                        words = [w for w, c in zip(words, np.cumsum(lost).tolist()) if not c]
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                got = pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], got], [*part.schema.names[:n], out])

    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))
