"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window is ``WINDOW`` = 13 consecutive words of an item (an item of fewer words, but not none, is one
window). A window is a set of five-word shingles (of all its words, if it has fewer than five). A document holds
the window only if it holds all its shingles, so for containment of 1 the necessary prefix is one shingle: the
rarest, by the number of documents that hold it. Two narrow passes over the documents for each block of the benchmark:

1. count, for each benchmark shingle, the documents that hold it (partial counts by task, then a sum by shingle);
2. look up only each window's rarest shingle, with its place in the window; a window must lie within the document
   (positions and length), and its words are then compared one by one, first by their hashes, then by their bytes.

The second pass writes a row of items and spans for each document that holds a window; a last narrow pass counts words
and joins these rows on by the text's hashes (128 bits). The join is a broadcast only where the rows measure at most
``SMALL`` bytes, and shuffles them otherwise.

One block is alive at a time: the benchmark is cut into pieces of ``PIECE`` words (which overlap by a window less one
word, so no window is lost), pieces are dealt to blocks of about ``BLOCK_BYTES`` of text by hash, and a block is read,
built as flat arrays, broadcast, used and destroyed before the next. A built block measures about ten bytes for a byte
of text, in the driver and in a task, whatever the benchmark's size; what grows with the benchmark is the number of passes.

Defined results: words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; a null text has none. An item
without words is no window; items of equal text are all reported; null item_ids are skipped. Empty tables give an
empty result or documents without hits. Equal rows get equal results; a very long text is read whole, some MB of others
beside it. Further columns of ``docs`` pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .tokens import FOLD, Hashes, hashed, slices

WINDOW = 13
SHINGLE = 5
PIECE = 1 << 16
BLOCK_BYTES = 4 << 20
SMALL = 32 << 20
MIN_SHARE = 20  # contaminated: MIN_SHARE * n_hit >= n_words
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 16


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _codes(ids: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit code of the ``k`` words from each place on."""
    out = np.full(max(0, len(ids) - k + 1), seed, np.uint64)
    for i in range(k):
        out ^= ids[i : len(out) + i]
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


class Block:
    """The windows and shingles of some benchmark pieces, as flat arrays over the pieces' words."""

    alive = 0  # blocks that exist in this process, and the most there were: for tests
    most = 0

    def __init__(self, items: list[tuple[str, bytes]]):
        Block.alive += 1
        Block.most = max(Block.most, Block.alive)
        split = [(name, ws) for name, text in items if (ws := words_of(text))]
        self.items = np.array([name for name, _ in split], object)
        flat = [w for _, ws in split for w in ws]
        self.text = b" ".join(flat)
        self.offset = np.concatenate([[0], np.cumsum([len(w) + 1 for w in flat], dtype=np.int64)]).astype(np.int32 if len(self.text) < 1 << 31 else np.int64)
        self.ids, begin = hashed([ws for _, ws in split], Hashes())
        del flat
        n = np.diff(begin)
        many = np.where(n > 0, np.maximum(1, n - WINDOW + 1), 0)
        item = np.repeat(np.arange(len(n)), many)
        start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + begin[:-1][item]
        size = np.minimum(n, WINDOW)[item].astype(np.int8)
        self._distinct(start, size, item)
        # Shingles of all sizes in one sorted array a size; ``base`` is where a size's begin among all.
        self.codes: dict[int, np.ndarray] = {}
        for k in sorted({min(SHINGLE, s) for s in np.unique(self.size).tolist()}):
            at = _codes(self.ids, k)
            used = np.zeros(len(at), bool)
            for s in self._sizes(k):
                mine = self.start[self.size == s]
                for j in range(s - k + 1):
                    used[mine + j] = True
            self.codes[k] = np.unique(at[used])
        self.base = dict(zip(self.codes, np.cumsum([0, *map(len, self.codes.values())])[:-1].tolist()))
        self.shingles = sum(map(len, self.codes.values()))
        self.seen = {k: _filter(c) for k, c in self.codes.items()}
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def __del__(self):
        Block.alive -= 1

    def __getstate__(self):
        return self.__dict__

    def __setstate__(self, state):
        Block.alive += 1
        self.__dict__.update(state)

    def _sizes(self, k: int) -> list[int]:
        return [s for s in np.unique(self.size).tolist() if min(SHINGLE, s) == k]

    def words(self, start: int, size: int) -> bytes:
        return self.text[self.offset[start] : self.offset[start + size] - 1]

    def _distinct(self, start: np.ndarray, size: np.ndarray, item: np.ndarray) -> None:
        """Equal windows once, with all their items. Equal codes are compared by bytes; were two windows of one code to
        differ, another seed would tell them apart."""
        seed = 0
        while True:
            code = np.zeros(len(start), np.uint64)
            for s in np.unique(size).tolist():
                mine = size == s
                code[mine] = _codes(self.ids, s, seed + s)[start[mine]]
            order = np.lexsort((item, code))
            new = np.concatenate([[True], np.diff(code[order]) != 0])[: len(order)]
            first = order[new][np.cumsum(new) - 1] if len(order) else order
            if all(self.words(start[a], size[a]) == self.words(start[b], size[b]) for a, b in zip(order[~new].tolist(), first[~new].tolist())):
                break
            seed += 1000
        rows = np.cumsum(new) - 1
        self.start, self.size = start[order[new]], size[order[new]]
        self.holder, self.held = item[order].astype(np.int32), np.append(np.flatnonzero(new), len(order))
        self.windows = len(self.start)
        del rows

    def _places(self, ids: np.ndarray, k: int, codes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places with one of the sorted ``codes``, and which one."""
        code = _codes(ids, k)
        at = np.flatnonzero(seen[code >> np.uint64(64 - (len(seen).bit_length() - 1))])
        if not len(codes) or not len(at):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(codes, code[at]), len(codes) - 1)
        same = codes[place] == code[at]
        return at[same], place[same]

    def counted(self, texts: list[bytes], memo: Hashes, held: np.ndarray) -> None:
        """Adds to ``held`` how many of the texts hold each shingle."""
        ids, begin = hashed(list(map(words_of, texts)), memo)
        for k, codes in self.codes.items():
            at, place = self._places(ids, k, codes, self.seen[k])
            doc = np.searchsorted(begin, at, "right") - 1
            inside = at + k <= begin[doc + 1]
            pair = np.unique(doc[inside] * len(codes) + place[inside])
            np.add.at(held, self.base[k] + pair % max(1, len(codes)), 1)

    def choose(self, held: np.ndarray) -> None:
        """Takes each window's rarest shingle; windows with a shingle that no document holds occur nowhere."""
        for k, codes in self.codes.items():
            found = []
            for s in self._sizes(k):
                mine = np.flatnonzero(self.size == s)
                for lo in range(0, len(mine), _STEP):
                    w = mine[lo : lo + _STEP]
                    best, at = np.full(len(w), np.iinfo(np.int64).max), np.zeros(len(w), np.int8)
                    which = np.zeros(len(w), np.int64)
                    for j in range(s - k + 1):
                        place = np.searchsorted(codes, self._code(self.start[w] + j, k))
                        n = held[self.base[k] + place]
                        less = n < best
                        best[less], at[less], which[less] = n[less], j, place[less]
                    found.append(np.stack([which, w, at])[:, best > 0])
            which, window, at = np.concatenate(found, axis=1)
            order = np.argsort(which, kind="stable")
            taken, first = np.unique(which[order], return_index=True)
            self.prefix[k] = (codes[taken], _filter(codes[taken]), np.append(first, len(order)), window[order], at[order].astype(np.int8))
        self.codes, self.seen = {}, {}

    def _code(self, at: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for i in range(k):
            out ^= self.ids[at + i]
            out *= _MIX
            out ^= out >> np.uint64(29)
        return out

    def hits(self, texts: list[bytes], memo: Hashes) -> list[tuple[int, list[str], list[int]]]:
        """(text, items, spans) of the texts that hold a window; spans are word offsets of hit runs: start, end, ..."""
        split = list(map(words_of, texts))
        ids, begin = hashed(split, memo)
        at, window, doc = [], [], []
        for k, (codes, seen, first, whose, place) in self.prefix.items():
            here, code = self._places(ids, k, codes, seen)
            many = first[code + 1] - first[code]
            row = np.repeat(first[code + 1] - np.cumsum(many), many) + np.arange(int(many.sum()))
            w = whose[row]
            start = np.repeat(here, many) - place[row]
            d = np.searchsorted(begin, np.repeat(here, many), "right") - 1
            inside = (start >= begin[d]) & (start + self.size[w] <= begin[d + 1])
            start, w, d = start[inside], w[inside], d[inside]
            for i in range(WINDOW):
                j = np.minimum(i, self.size[w] - 1)
                same = ids[start + j] == self.ids[self.start[w] + j]
                start, w, d = start[same], w[same], d[same]
            at.append(start)
            window.append(w)
            doc.append(d)
        found: dict[int, tuple[set[int], list[tuple[int, int]]]] = {}
        for a, w, d in zip(*(np.concatenate([np.zeros(0, np.int64), *x]).tolist() for x in (at, window, doc))):
            lo, size = a - int(begin[d]), int(self.size[w])
            if b" ".join(split[d][lo : lo + size]) == self.words(int(self.start[w]), size):
                items, runs = found.setdefault(d, (set(), []))
                items.update(self.holder[self.held[w] : self.held[w + 1]].tolist())
                runs.append((lo, lo + size))
        out = []
        for d, (items, runs) in sorted(found.items()):
            spans: list[int] = []
            for lo, hi in sorted(runs):
                if spans and lo <= spans[-1]:
                    spans[-1] = max(spans[-1], hi)
                else:
                    spans += [lo, hi]
            out.append((d, sorted(set(self.items[list(items)])), spans))
        return out


def _filter(codes: np.ndarray) -> np.ndarray:
    """Which upper bits a code may have: eight to sixteen slots for each."""
    bits = max(10, (8 * len(codes)).bit_length())
    seen = np.zeros(1 << bits, bool)
    seen[codes >> np.uint64(64 - bits)] = True
    return seen


def _pieces(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(i, t): items with words, in pieces of ``PIECE`` words that overlap by a window less one."""

    def run(batches):
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words_of(t)
                step = PIECE - WINDOW + 1
                parts = [b" ".join(ws[lo : lo + PIECE]) for lo in range(0, max(1, len(ws) - WINDOW + 1), step)]
                yield pa.RecordBatch.from_pydict({"i": pa.array([name] * len(parts), pa.string()), "t": pa.array(parts, pa.binary())})

    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "i string, t binary")


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Block]:
    rows = _pieces(benchmark, item_id, text)
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        got = part.toArrow()
        yield Block(list(zip(got.column("i").to_pylist(), got.column("t").to_pylist())))


def _keys(text: str) -> dict[str, Column]:
    """What tells texts apart: 128 bits of hash, and null from the empty text by nothing, as neither has a word."""
    t = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    return {"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit("second"), t)}


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k1, k2, n_words, n_hit, items, spans) of each distinct text of ``docs`` that holds a window."""
    spark = docs.sparkSession
    sc, tables = spark.sparkContext, []
    keyed = docs.select(F.col(text).alias("t"), *(c.alias(k) for k, c in _keys(text).items()))
    for block in _blocks(benchmark, item_id, item_text):
        plain = sc.broadcast(block)

        def count(batches, plain=plain):
            memo, held = Hashes(), np.zeros(plain.value.shingles, np.int64)
            for b in batches:
                for _, part in slices(b.column(0), 4 << 20):
                    plain.value.counted(part, memo, held)
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({"p": pa.array(at), "n": pa.array(held[at])})

        got = keyed.select("t").mapInArrow(count, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).toArrow()
        held = np.zeros(block.shingles, np.int64)
        held[got.column("p").to_numpy()] = got.column("n").to_numpy()
        block.choose(held)
        plain.destroy()
        chosen = sc.broadcast(block)

        def probe(batches, chosen=chosen):
            memo = Hashes()
            for b in batches:
                for first, part in slices(b.column(0), 4 << 20):
                    found = chosen.value.hits(part, memo)
                    at = pa.array([first + d for d, _, _ in found], pa.int64())
                    n = pa.array([len(words_of(part[d])) for d, _, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), n, pa.array([x for _, x, _ in found], pa.list_(pa.string())), pa.array([x for _, _, x in found], pa.list_(pa.int32()))], ["k1", "k2", "n_words", "items", "spans"])

        tables.append(written(keyed.mapInArrow(probe, "k1 long, k2 long, n_words long, items array<string>, spans array<int>"), "benchmark_hits")[0])
        chosen.destroy()
        del block, plain, chosen, count, probe
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    # Rows of equal texts are equal, so a text has at most one row a block here.
    met = every.groupBy("k1", "k2", "n_words").agg(F.collect_set(F.struct("items", "spans")).alias("x"))
    items = F.array_sort(F.array_distinct(F.flatten("x.items")))
    runs = F.array_sort(F.flatten(F.transform("x", lambda r: F.transform(F.sequence(F.lit(0), F.size(r["spans"]) - 2, F.lit(2)), lambda i: F.struct(F.get(r["spans"], i).alias("a"), F.get(r["spans"], i + 1).alias("b"))))))
    none = F.array().cast("array<int>")
    last = lambda s: F.element_at(s, -1)

    def join(s, r):
        meets = (F.size(s) > 0) & (r["a"] <= F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(-1)))
        return F.when(meets, F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.greatest(last(s), r["b"])))).otherwise(F.concat(s, F.array(r["a"], r["b"])))

    one = F.size("x") == 1
    spans = F.when(one, F.get("x", F.lit(0))["spans"]).otherwise(F.aggregate(runs, none, join))
    out = met.select("k1", "k2", "n_words", items.alias("items"), spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: x - s)
    return out.select("k1", "k2", "n_words", n_hit.cast("long").alias("n_hit"), "items", "spans")


def _joinable(rows: DataFrame, size: Column) -> DataFrame:
    """``rows``, marked for broadcast if they measure at most ``SMALL`` bytes."""
    measured = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(rows) if measured <= SMALL else rows


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "contamination") -> DataFrame:
    """``docs`` and a struct ``out``: n_words, n_hit, items (sorted strings) and spans (word offsets of hit runs: start, end, ...)."""
    out, names = fresh(docs, out), {k: fresh(docs, f"_bm_{k}") for k in ("k1", "k2", "n_hit", "items", "spans")}
    found = hits(docs, benchmark, text, item_id, item_text)
    found = _joinable(found, 64 + 24 * F.size("items") + 4 * F.size("spans")).select(*(F.col(k).alias(v) for k, v in names.items()))
    keyed = docs.withColumns({names[k]: c for k, c in _keys(text).items()})
    met = keyed.join(found, [names["k1"], names["k2"]], "left")
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    told = F.struct(
        n.alias("n_words"),
        F.coalesce(F.col(names["n_hit"]), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.col(names["items"]), F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col(names["spans"]), F.array().cast("array<int>")).alias("spans"),
    )
    return met.select(*(F.col(f"`{c}`") for c in docs.columns), told.alias(out))


def contaminated(found: Column) -> Column:
    """The rule over the struct that annotate() adds."""
    return (found["n_hit"] > 0) & (MIN_SHARE * found["n_hit"] >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that the rule leaves; the columns of ``docs``. Rows move only where the contaminated texts are too many to broadcast."""
    k1, k2 = fresh(docs, "_bm_k1"), fresh(docs, "_bm_k2")
    bad = hits(docs, benchmark, text, item_id, item_text).where(contaminated(F.struct("n_hit", "n_words"))).select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    keyed = docs.withColumns(dict(zip((k1, k2), _keys(text).values())))
    return keyed.join(_joinable(bad, F.lit(64)), [k1, k2], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
