"""Byte-level BPE by overlapping chunks: pre-tokenise chunks in parallel, stitch at common boundaries, encode, decode.

A text of up to ``CHUNK`` characters is one chunk and is encoded where it lies. A longer one is cut into chunks that
overlap by ``OVERLAP`` characters and are dealt over the cluster. Each chunk is pre-tokenised from its own start, so
that its first boundaries may be wrong; but from the first boundary that it shares with the chunk before it, both
agree, as the pattern looks only forward. That first shared boundary after a character that is no white space (there
the pattern's look-ahead over the cut changes nothing) is the cut, and each chunk encodes what lies between its cuts.
Where an overlap has no such boundary (a run of one kind longer than the overlap), the chunks are joined and the
whole stretch is pre-tokenised again before it is encoded, so that results never depend on where chunks begin.

A text's pieces come together by document for the result, which is one row of that document's size; only texts over
``CHUNK`` characters are shuffled, chunk by chunk.

Defined results: null and empty texts have no tokens and decode to no bytes; special tokens are never made; ids that
the vocabulary lacks fail when decoding. Equal rows give equal rows; further columns pass through.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, shuffle_partitions

CHUNK = 1 << 15
OVERLAP = 1 << 9
#: Above this many characters a stretch is split by the pattern here, piece by piece, not by the library's matcher.
LONG = 1 << 18


@lru_cache(maxsize=2)
def _coder(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, regex.Pattern]:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}), regex.compile(pattern)


@lru_cache(maxsize=2)
def _raw(ranks: bytes) -> dict[int, bytes]:
    return {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines())}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_stretch(text: str, ranks: bytes, pattern: str) -> list[int]:
    coder, matcher = _coder(ranks, pattern)
    if len(text) <= LONG:
        return coder.encode_ordinary(text)
    out: list[int] = []
    for m in matcher.finditer(text):
        out += coder._encode_single_piece(m[0])
    return out


def decode_ids(ids: list, ranks: bytes) -> list[bytes]:
    """The raw bytes of each list of ids, one after another (null: none)."""
    raw = _raw(ranks).__getitem__
    return [b"".join(map(raw, x or ())) for x in ids]


def _boundaries(text: str, start: int, pattern: regex.Pattern, until: int) -> list[int]:
    """Ends, after ``start``, of the pre-tokens of ``text`` that a cut may follow and the text's end cannot change."""
    found = []
    for m in pattern.finditer(text):
        if m.end() >= len(text) or m.end() > until:
            break
        if m.end() >= start and not text[m.end() - 1].isspace():
            found.append(m.end())
    return found


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP, keep: bool = True, decoded: str | None = None) -> DataFrame:
    """``docs`` and ``out``, the token ids as array<int>; the text itself only if ``keep``; ``decoded``: as ``decode`` gives,
    made by the worker that has the ids, so that no second one is held beside it."""
    out = fresh(docs, out)
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    given = docs.sparkSession.sparkContext.broadcast(ranks)
    at = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if keep or i != at]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    if decoded:
        schema = schema.add(decoded := fresh(docs.withColumn(out, F.lit(0)), decoded), T.BinaryType(), False)

    def whole(batches):
        for b in batches:
            for lo, part in _slices(b):
                ids = [encode_stretch(t or "", given.value, pattern) for t in part.column(at).to_pylist()]
                plain = [pa.array(decode_ids(ids, given.value), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(ids, pa.list_(pa.int32())), *plain], schema.names)

    size = F.coalesce(F.char_length(F.col(text)), F.lit(0))
    short = docs.where(size <= chunk).mapInArrow(whole, schema)
    long = _long(docs.where(size > chunk), text, out, given, pattern, chunk, overlap)
    long = long if keep else long.drop(text)
    return short.unionByName(decode(long, ranks, out, decoded) if decoded else long)


def _slices(b: pa.RecordBatch, rows: int = 64):
    for lo in range(0, b.num_rows, rows):
        yield lo, b.slice(lo, rows)


def _long(docs: DataFrame, text: str, out: str, given, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Texts of several chunks. A row is named by a random key made where it is read, written down before it is used."""
    from .common import cut_lineage

    key, names = fresh(docs, "_bpe_row"), docs.columns
    keyed = cut_lineage(docs.withColumn(key, F.uuid()).select(key, *names))
    n = shuffle_partitions(docs.sparkSession)

    def cut(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for no, start in enumerate(range(0, len(t), chunk)):
                    yield pa.RecordBatch.from_pydict({"row": [k], "no": pa.array([no], pa.int32()), "part": [t[start : start + chunk + overlap]]})

    chunks = keyed.select(key, text).mapInArrow(cut, "row string, no int, part string").repartition(n, "row", "no")

    def zones(batches):
        """Of each chunk the boundaries in its head zone and in its tail zone, as offsets into the zone."""
        _, matcher = _coder(given.value, pattern)
        for b in batches:
            head, tail = [], []
            for t in b.column("part").to_pylist():
                head.append(_boundaries(t, 1, matcher, overlap))
                tail.append([x - chunk for x in _boundaries(t, chunk + 1, matcher, chunk + overlap)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], [*b.schema.names, "head", "tail"])

    zoned = cut_lineage(chunks.mapInArrow(zones, "row string, no int, part string, head array<int>, tail array<int>"))
    # A cut is known once the chunk before is true up to it: its own head may be wrong only before its own cut, and zones don't meet.
    before = zoned.select("row", (F.col("no") + 1).alias("no"), "tail")
    met = zoned.join(before.withColumnRenamed("tail", "left_tail"), ["row", "no"], "left")
    cuts = met.select("row", "no", F.when(F.col("no") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "left_tail"))).alias("cut"))
    # A chunk ends at the next chunk's cut; chunks without a cut hang on the last one that has one.
    here = zoned.select("row", "no", "part").join(cuts, ["row", "no"]).join(cuts.select("row", (F.col("no") - 1).alias("no"), F.col("cut").alias("end"), F.lit(True).alias("more")), ["row", "no"], "left")
    body = F.when(F.col("more").isNull(), F.col("part")).otherwise(F.substring(F.col("part"), F.lit(1), F.lit(chunk) + F.coalesce("end", F.lit(0))))
    pieces = here.select("row", "no", F.col("cut").isNotNull().alias("begins"), (F.col("more").isNotNull() & F.col("end").isNull()).alias("goes_on"), F.when(F.col("cut") > 0, F.substring(body, F.col("cut") + 1, F.char_length(body))).otherwise(body).alias("body"))
    alone = pieces.where("begins and not goes_on").select("row", "no", "body")
    split = pieces.where("not begins or goes_on")
    # Rare: stretches over several chunks. A stretch is numbered by the last chunk at or before it that begins one.
    from pyspark.sql import Window as W

    first = F.last(F.when(F.col("begins"), F.col("no")), ignorenulls=True).over(W.partitionBy("row").orderBy("no").rowsBetween(W.unboundedPreceding, 0))
    joined = (
        split.withColumn("first", first)
        .groupBy("row", F.col("first").alias("no"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "body"))), lambda x: x["body"]), "").alias("body"))
    )

    def coded(batches):
        for b in batches:
            ids = [encode_stretch(t or "", given.value, pattern) for t in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("no"), pa.array(ids, pa.list_(pa.int32()))], ["row", "no", "ids"])

    done = alone.unionByName(joined).repartition(n, "row", "no").mapInArrow(coded, "row string, no int, ids array<int>")
    parts = done.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias(out))
    back = keyed.join(parts.withColumnRenamed("row", key), key)
    return back.select(*(F.col(f"`{c}`") for c in names), F.coalesce(out, F.array().cast("array<int>")).alias(out))


def decode(coded: DataFrame, ranks: bytes, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``coded`` and ``out``: the raw bytes of all ids, one after another (null ids: none)."""
    out, at = fresh(coded, out), coded.columns.index(ids)
    given = coded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        for b in batches:
            for _, part in _slices(b):
                plain = decode_ids(part.column(at).to_pylist(), given.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(plain, pa.binary())], [*b.schema.names, out])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(out, T.BinaryType(), False)]))
