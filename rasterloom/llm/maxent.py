"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one end token a text. The probability of a token is
P(class | features) * P(token | class, features):

* Classes. The ``FRONT`` most frequent tokens are clustered by which of the most frequent tokens stand before and after them
  (k-means); a cluster's tokens, by frequency, fill classes of ``PLACES`` places. Less frequent ones are in ``BANDS``
  classes by ranges of training frequency; the last class holds all rare ones, seen once or unseen.
* P(class | features) is a softmax over weights of features of the tokens before: the last token (hashed), the two last
  together (hashed), and the classes of both together.
* P(token | class, features) is a second softmax, over the class's tokens: their log-frequency, weights of the last
  token within this class (hashed) and, as a skip, of the class of the one before it. In the classes by frequency it is c / N_k,
  in the last class (c + 1) / (N_k + V_k + 1), which leaves one share for an unseen token. So the probabilities of all
  training tokens and one unseen one sum to one (tested).

Weights are rows of a table of fixed size, the model's capacity; exact counts of all tokens grow with the corpus.

* Counts cover every training token: partial counts by run of text, then a sum by token hash (64 bits).
* Neighbours are counted over all training texts. These are then dealt to ``FOLDS`` folds by their ids' hash, and each fold
  is a round of training, so every training text moves weights. A task updates its own copy of the weights batch by batch
  (steps scaled by each row's gradients so far), and the copies are averaged row by row, weighted by their tokens, by groups
  of ``ROWS`` rows. There is a copy for each ``COPY_TOKENS`` tokens of a round, so what they send grows with the input and
  not with its partitions.
* Scoring: frequent tokens (at most ``HEAD``, a proven bound) are broadcast with their counts. Occurrences of others
  are joined with the counts by hash, then summed by row; nothing else is shuffled, and no text is.

Defined results: null and empty texts have the end token only; each row is scored for itself, so equal rows get equal
scores and null or repeated ids do no harm; without training texts, or of an empty table, all counts are 0. A text's
tokens are in memory at once, as numbers (some 100 bytes a token while its batch is scored), its features by batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage
from .tokens import Hashes, numbered, runs, sums

HEAD = 1 << 19
FRONT = 6144
PLACES = 96
CLUSTERS = 16
NEIGHBOURS = 64
BANDS = 8
OUTER = 1 << 14  # rows of a hashed feature of the class softmax
INNER = 1 << 15  # rows of the hashed feature within classes
FOLDS = 2
RATE = 1.0
BATCH = 1 << 14
COUNTED = 8 << 20  # bytes of texts that are counted at once
CACHED = 1 << 9  # distributions that are made at once
STEP = 1 << 9  # gradients, or sums of them, that are made at once, in place
MANY = 48  # rows whose gradients are summed by a product beyond
COPY_TOKENS = 1 << 21
ROWS = 64  # rows of weights that are sent together
FINE = 2048.0  # moves are sent as whole numbers of this part
MOVED = "kind byte, at int, data binary"
# The end token: no word has a space.
END = b" "
_MIX = np.uint64(0x9E3779B97F4A7C15)


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(h, c): how often each token, by its hash, occurs in all texts."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, texts in runs(b.column(0), COUNTED):
                _, at, h = numbered(texts, END)
                held.append((h, np.bincount(at, minlength=len(h))))
                size += len(h)
                if size >= 1 << 20:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size >= 1 << 19:
                        yield _counted(held)
                        held, size = [], 0
        if held:
            yield _counted(held)

    return docs.select(F.col(text)).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes and their counts, of several lists of both."""
    h, c = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c[order], first)


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    h, c = _merged(held)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])


def coded(texts: pa.Array, look) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text's tokens begin (and the last one's end); of all tokens, the hash and what ``look`` tells of hashes."""
    begin, at, h = numbered(texts, END)
    # Ordered hashes are looked up faster.
    order = np.argsort(h)
    back = np.empty(len(h), np.int64)
    back[order] = np.arange(len(h))
    h, at = h[order], back[at]
    return begin, [x[at] for x in (h, *look(h))]


class Vocabulary:
    """Frequent tokens by hash, with counts, classes and places in them, and the sizes of all classes."""

    def __init__(self, h: np.ndarray, c: np.ndarray, rare_n: int, rare_v: int):
        """Tokens seen more than once and frequent enough; rare_n, rare_v: occurrences and number of all others."""
        order = np.lexsort((h, -c))
        self.front = h[order][:FRONT]
        self.counts = c[order][:FRONT].astype(np.float64)
        self.rest_h, self.rest_c = h[order][FRONT:], c[order][FRONT:]
        self.rare_n, self.rare_v = rare_n, rare_v
        self.total = int(c.sum()) + rare_n

    def arrange(self, near: np.ndarray) -> None:
        """Fills the classes; near: (front tokens, 2 * NEIGHBOURS) counts of neighbours."""
        shares = np.sqrt(near / np.maximum(self.counts, 1)[:, None])
        cluster = _clusters(shares, np.sqrt(self.counts))
        k, place, self.inner_classes = np.zeros(len(self.front), np.int64), np.zeros(len(self.front), np.int64), 0
        for j in range(CLUSTERS):
            mine = np.flatnonzero(cluster == j)
            k[mine] = self.inner_classes + np.arange(len(mine)) // PLACES
            place[mine] = np.arange(len(mine)) % PLACES
            self.inner_classes += -(-len(mine) // PLACES)
        # Tokens of one count are in one band, whatever their order.
        down = self.rest_c.astype(np.float64)
        before = np.cumsum(down) - down
        band = np.minimum(before[np.searchsorted(-down, -down, "left")] * (BANDS - 1) // max(1.0, down.sum()), BANDS - 2).astype(np.int64) if len(down) else np.zeros(0, np.int64)
        self.classes = self.inner_classes + BANDS
        every = np.concatenate([self.front, self.rest_h])
        order = np.argsort(every)
        self.h = every[order]
        self.c = np.concatenate([self.counts, self.rest_c])[order].astype(np.int64)
        self.k = np.concatenate([k, self.inner_classes + band])[order]
        self.place = np.concatenate([place, np.full(len(band), -1)])[order]
        n = np.bincount(self.k, weights=self.c, minlength=self.classes)
        n[-1] = self.rare_n
        self.prior = np.log((n + 1) / (self.total + self.classes)).astype(np.float32)
        # log10 of what a count is divided by in the classes without an inner softmax.
        size = np.maximum(n, 1)
        size[-1] = self.rare_n + self.rare_v + 1
        self.size = np.log10(size)
        self.bias = np.full((self.inner_classes, PLACES), -1e9, np.float32)
        self.bias[k, place] = np.log(np.maximum(self.counts, 1))
        del self.rest_h, self.rest_c

    def look(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, place (-1: none) and count of each token; the last class and 0 for those that are rare."""
        if not len(self.h):
            return np.full(len(ids), self.classes - 1), np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self.h, ids), len(self.h) - 1)
        held = self.h[at] == ids
        return np.where(held, self.k[at], self.classes - 1), np.where(held, self.place[at], -1), np.where(held, self.c[at], 0)


def _clusters(x: np.ndarray, weight: np.ndarray, rounds: int = 15) -> np.ndarray:
    """k-means over at most ``FRONT`` rows, begun at the heaviest ones that differ."""
    if not len(x):
        return np.zeros(0, np.int64)
    chosen = np.unique(x[np.random.default_rng(0).permutation(len(x))[: 4 * CLUSTERS]], axis=0)[:: max(1, len(np.unique(x[:1], axis=0)))]
    centre = chosen[np.linspace(0, len(chosen) - 1, min(CLUSTERS, len(chosen))).astype(int)]
    for _ in range(rounds):
        own = (x @ centre.T - 0.5 * (centre * centre).sum(axis=1)).argmax(axis=1)
        heavy = np.bincount(own, weights=weight, minlength=len(centre))
        for d in range(x.shape[1]):
            mean = np.bincount(own, weights=weight * x[:, d], minlength=len(centre)) / np.maximum(heavy, 1e-9)
            centre[:, d] = np.where(heavy > 0, mean, centre[:, d])
    return own


def _before(x: np.ndarray, begin: np.ndarray, k: int, none) -> np.ndarray:
    """The value ``k`` places before, ``none`` where that is before the text's start."""
    out = np.full(len(x), none, x.dtype)
    out[k:] = x[:-k]
    for j in range(k):
        at = begin[:-1] + j
        out[at[at < begin[1:]]] = none
    return out


def _bucket(h: np.ndarray, size: int) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(40)).astype(np.int64) & (size - 1)


class Weights:
    """Rows of weights of both softmaxes, and the squares of each row's gradients so far."""

    def __init__(self, classes: int, inner_classes: int):
        self.classes, self.inner_classes = classes, inner_classes
        self.outer = np.zeros((2 * OUTER + (classes + 1) ** 2, classes), np.float32)
        self.inner = np.zeros((INNER + (classes + 1) * inner_classes, PLACES), np.float32)
        self.outer_q, self.inner_q = np.ones(len(self.outer), np.float32), np.ones(len(self.inner), np.float32)

    def features(self, ids: np.ndarray, k: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the class softmax and of the inner one (only of use where a class has places): (features, tokens)."""
        one, two = _before(ids, begin, 1, 0), _before(ids, begin, 2, 0)
        class_1, class_2 = _before(k, begin, 1, self.classes), _before(k, begin, 2, self.classes)
        outer = np.stack([_bucket(one, OUTER), OUTER + _bucket((one * _MIX) ^ two, OUTER), 2 * OUTER + class_1 * (self.classes + 1) + class_2])
        own = np.minimum(k, self.inner_classes - 1)
        inner = np.stack([_bucket((one * _MIX) ^ own.astype(np.uint64), INNER), INNER + class_2 * self.inner_classes + own])
        return outer.astype(_small(len(self.outer))), inner.astype(_small(len(self.inner)))


def _small(size: int) -> type:
    """A type for numbers below ``size``; those of 16 bits are sorted fast."""
    return np.uint16 if size <= 1 << 16 else np.int64


def _scores(w: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the rows of weights and the bias (one for all, or one a token), their exponentials, and the sums of these."""
    z, ones = np.take(w, rows[0], axis=0, mode="clip"), np.ones(w.shape[1], np.float32)
    for r in rows[1:]:
        z += np.take(w, r, axis=0, mode="clip")
    z += bias
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(z)
        total = e @ ones
    if len(z) and not (total.min() > 1e-30 and total.max() < 1e30):
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=e)
        total = e @ ones
    return z, e, total


def log_softmax(w: np.ndarray, rows: np.ndarray, bias: np.ndarray, of: np.ndarray | None, chosen: np.ndarray) -> np.ndarray:
    """Natural log of the chosen outcome's probability; the bias of a token is ``bias[of]``, or ``bias`` for all.

    Tokens of the same rows share one distribution, which is made once."""
    out = np.empty(len(chosen))
    key = np.zeros(len(chosen), np.uint64)
    for r in (*rows, *(() if of is None else (of,))):
        key = (key << np.uint64(21)) ^ r.astype(np.uint64)
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(new, len(key))
    first, many = order[new], np.diff(ends)
    held, ones = np.empty((2, CACHED, w.shape[1]), np.float32), np.ones(w.shape[1], np.float32)
    for lo in range(0, len(new), CACHED):
        part = first[lo : lo + CACHED]
        z, e = held[:, : len(part)]
        total = _exponentials(w, rows[:, part], bias, None if of is None else of[part], z, e, e, ones)
        if total is None:
            z, _, total = _scores(w, rows[:, part], bias if of is None else np.take(bias, of[part], axis=0))
        back = np.repeat(np.arange(len(part)), many[lo : lo + CACHED])
        mine = order[ends[lo] : ends[min(lo + CACHED, len(new))]]
        out[mine] = z[back, chosen[mine]] - np.log(total)[back]
    return out


def _exponentials(w: np.ndarray, rows: np.ndarray, bias: np.ndarray, of: np.ndarray | None, z: np.ndarray, more: np.ndarray, e: np.ndarray, ones: np.ndarray) -> np.ndarray | None:
    """Fills ``z`` with the sums of the rows of weights and the bias, then ``e`` with their exponentials: the sums of these,
    or None if they leave the numbers' range. ``more`` is spoilt; ``e`` may be ``z`` or ``more``."""
    np.take(w, rows[0], axis=0, mode="clip", out=z)
    for r in rows[1:]:
        z += np.take(w, r, axis=0, mode="clip", out=more)
    z += bias if of is None else np.take(bias, of, axis=0, mode="clip", out=more)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(z, out=e)
        total = e @ ones
    return total if total.min() > 1e-30 and total.max() < 1e30 else None


def summed(g: np.ndarray, r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different values of ``r``, and for each the sum of its rows of ``g``: by a product if it has many, else row by
    row. Those of most rows come first, ``STEP`` at once, in a place that the next ones take."""
    order = np.argsort(r, kind="stable")
    ordered = r[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(r) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(r))
    down = np.argsort(-size, kind="stable")
    first, size = first[down], size[down]
    values, heavy = ordered[first].astype(np.int64), int(np.searchsorted(-size, -MANY, "left"))
    ones, held = np.ones(len(r), g.dtype), np.empty((2, STEP, g.shape[1]), g.dtype)
    for lo in range(0, len(values), STEP):
        hi = min(lo + STEP, len(values))
        light, out, more = max(lo, min(heavy, hi)), held[0, : hi - lo], held[1]
        np.take(g, order[first[lo:hi]], axis=0, mode="clip", out=out)
        for j in range(1, int(size[light]) if light < hi else 0):
            last = lo + int(np.searchsorted(-size[lo:hi], -j, "left"))
            out[light - lo : last - lo] += np.take(g, order[first[light:last] + j], axis=0, mode="clip", out=more[: last - light])
        for i in range(lo, light):
            at = order[first[i] : first[i] + size[i]]
            np.dot(ones[: len(at)], np.take(g, at, axis=0, mode="clip"), out=out[i - lo])
        yield values[lo:hi], out


def totals(g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of ``summed``, by value."""
    values, out = (np.concatenate(x) for x in zip(*((v, t.copy()) for v, t in summed(g, r))))
    order = np.argsort(values)
    return values[order], out[order]


def _step(w: np.ndarray, q: np.ndarray, rows: np.ndarray, bias: np.ndarray, of: np.ndarray | None, chosen: np.ndarray) -> None:
    """One batch: each row moves along the sum of its tokens' gradients, by a length that falls with those so far."""
    g = np.empty((len(chosen), w.shape[1]), np.float32)
    ones, held = np.ones(w.shape[1], np.float32), np.empty((STEP, w.shape[1]), np.float32)
    for lo in range(0, len(chosen), STEP):
        part = slice(lo, min(lo + STEP, len(chosen)))
        e = g[part]
        total = _exponentials(w, rows[:, part], bias, None if of is None else of[part], e, held[: len(e)], e, ones)
        if total is None:
            _, e[:], total = _scores(w, rows[:, part], bias if of is None else np.take(bias, of[part], axis=0))
        e *= (-1 / total)[:, None]
    g.reshape(-1)[np.arange(0, g.size, w.shape[1]) + chosen] += 1
    for r in rows:
        for here, total in summed(g, r):
            q[here] += np.einsum("ij,ij->i", total, total)
            total *= (RATE / np.sqrt(q[here]))[:, None]
            total += np.take(w, here, axis=0, mode="clip")
            w[here] = total


def _looked(vocabulary: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    which, back = np.unique(ids, return_inverse=True)
    return tuple(x[back] for x in vocabulary.look(which))


def _ranks(front: np.ndarray):
    """A function that tells the places of hashes in ``front`` (-1: none)."""
    order = np.argsort(front)
    ordered = front[order]

    def look(h: np.ndarray) -> tuple[np.ndarray]:
        if not len(front):
            return (np.full(len(h), -1),)
        at = np.minimum(np.searchsorted(ordered, h), len(front) - 1)
        return (np.where(ordered[at] == h, order[at], -1),)

    return look


def neighbours(rank: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """(front tokens, 2 * NEIGHBOURS): how often each of the most frequent tokens (the last column: any other) is before and after."""
    after = np.append(rank[1:], -1)
    after[begin[1:] - 1] = -1
    out = np.zeros((size, 2 * NEIGHBOURS), np.int64)
    known = np.flatnonzero(rank >= 0)
    for side, other in enumerate((_before(rank, begin, 1, -1), after)):
        near = np.where((other >= 0) & (other < NEIGHBOURS - 1), other, NEIGHBOURS - 1)
        out += np.bincount(rank[known] * (2 * NEIGHBOURS) + side * NEIGHBOURS + near[known], minlength=out.size).reshape(out.shape)
    return out


def _near(docs: DataFrame, front: np.ndarray) -> np.ndarray:
    given = docs.sparkSession.sparkContext.broadcast(front)

    def run(batches):
        look, total = _ranks(given.value), None
        for b in batches:
            for _, texts in runs(b.column(0)):
                begin, (_, rank) = coded(texts, look)
                found = neighbours(rank, begin, len(given.value))
                total = found if total is None else total + found
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    got = docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(front), 2 * NEIGHBOURS))
    out.reshape(-1)[got.column("at").to_numpy()] = got.column("n").to_numpy()
    given.destroy()
    return out


def _train(docs: DataFrame, vocabulary, fold: Column, n_tokens: int) -> Weights:
    """``docs`` (text), of ``n_tokens`` tokens: a round over each fold, so that every text moves weights once."""
    sc, w = docs.sparkSession.sparkContext, Weights(vocabulary.value.classes, vocabulary.value.inner_classes)
    copies, sizes = -(-n_tokens // (FOLDS * COPY_TOKENS)) or 1, (len(w.outer), len(w.inner))
    for r in range(FOLDS):
        given = sc.broadcast(w)

        def run(batches):
            own = seen = None
            for b in batches:
                for _, texts in runs(b.column(0)):
                    if own is None:
                        own = Weights(given.value.classes, given.value.inner_classes)
                        for name in ("outer", "inner", "outer_q", "inner_q"):
                            getattr(own, name)[:] = getattr(given.value, name)
                        seen = {"outer": np.zeros(len(own.outer), np.int64), "inner": np.zeros(len(own.inner), np.int64)}
                    begin, (ids, k, place, _) = coded(texts, vocabulary.value.look)
                    outer, inner = own.features(ids, k, begin)
                    for lo in range(0, len(ids), BATCH):
                        part = slice(lo, lo + BATCH)
                        _step(own.outer, own.outer_q, outer[:, part], vocabulary.value.prior, None, k[part])
                        some = lo + np.flatnonzero(place[part] >= 0)
                        if len(some):
                            _step(own.inner, own.inner_q, inner[:, some], vocabulary.value.bias, k[some], place[some])
                    for x in outer:
                        seen["outer"] += np.bincount(x, minlength=len(own.outer))
                    for x in inner[:, place >= 0]:
                        seen["inner"] += np.bincount(x, minlength=len(own.inner))
            if own is None:
                return
            for kind, name in enumerate(("outer", "inner")):
                table, old, q = getattr(own, name), getattr(given.value, name), getattr(own, name + "_q") - getattr(given.value, name + "_q")
                for at in range(0, len(table), ROWS):
                    here = slice(at, at + ROWS)
                    if seen[name][here].any():
                        moved = np.clip(np.rint((table[here] - old[here]) * FINE), -32767, 32767).astype(np.int16)
                        data = seen[name][here].tobytes() + q[here].tobytes() + moved.tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int8()), pa.array([at], pa.int32()), pa.array([data], pa.binary())], ["kind", "at", "data"])

        def merged(key, copies):
            rows = min(ROWS, sizes[key[0].as_py()] - key[1].as_py())
            n = q = moved = 0
            # In a fixed order, as q is a sum of floats; the others are sums of whole numbers.
            for data in sorted(copies.column("data").to_pylist()):
                seen = np.frombuffer(data, np.int64, rows)
                n = n + seen
                q = q + seen * np.frombuffer(data, np.float32, rows, 8 * rows).astype(np.float64)
                moved = moved + seen[:, None] * np.frombuffer(data, np.int16, -1, 12 * rows).reshape(rows, -1)
            n = np.maximum(n, 1)
            data = (q / n).astype(np.float32).tobytes() + (moved / (FINE * n[:, None])).astype(np.float32).tobytes()
            return pa.table({"kind": pa.array([key[0].as_py()], pa.int8()), "at": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

        part = docs.where(F.pmod(fold, F.lit(FOLDS)) == r).select("text").coalesce(copies).mapInArrow(run, MOVED)
        for kind, at, data in zip(*part.groupBy("kind", "at").applyInArrow(merged, MOVED).toArrow().columns):
            kind, at, data = kind.as_py(), at.as_py(), data.as_buffer()
            name = ("outer", "inner")[kind]
            table, q = getattr(w, name)[at : at + ROWS], getattr(w, name + "_q")[at : at + ROWS]
            q += np.frombuffer(data, np.float32, len(q))
            table += np.frombuffer(data, np.float32, -1, 4 * len(q)).reshape(table.shape)
        given.destroy()
    return w


def log_probability(vocabulary: Vocabulary, w: Weights, ids: np.ndarray, begin: np.ndarray, known: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability, but for rare tokens without their log10(c + 1), and each token's count (0: rare).

    ``known``: class, place and count of each token, if they were looked up before."""
    k, place, c = known or _looked(vocabulary, ids)
    outer, inner = w.features(ids, k, begin)
    out = log_softmax(w.outer, outer, vocabulary.prior, None, k) / math.log(10)
    some = np.flatnonzero(place >= 0)
    out[some] += log_softmax(w.inner, inner[:, some], vocabulary.bias, k[some], place[some]) / math.log(10)
    other = np.flatnonzero(place < 0)
    out[other] += np.log10(np.maximum(c[other], 1)) - vocabulary.size[k[other]]
    return out, c


def fit(learned: DataFrame, counts: DataFrame, fold: Column) -> tuple[Vocabulary, Weights, int, int]:
    """Vocabulary, weights, tokens and distinct tokens of the training rows ``learned`` (text); ``counts``: (h, c)."""
    # How many tokens have counts in each half-power-of-two range: a few dozen rows.
    level = F.floor(2 * F.log2("c")).cast("int")
    ranges = sorted(counts.groupBy(level.alias("l")).agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r.l)
    least, held, n_all, v_all = 1 << 62, 0, sum(r.n for r in ranges), sum(r.v for r in ranges)
    for r in ranges:
        if held + r.v > HEAD or r.least < 2:
            break
        held, least = held + r.v, r.least
    head = counts.where(F.col("c") >= least).toArrow()
    h, c = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy().astype(np.int64)
    found = Vocabulary(h, c, n_all - int(c.sum()), v_all - len(c))
    found.least = least
    found.arrange(_near(learned.select("text"), found.front))
    given = learned.sparkSession.sparkContext.broadcast(found)
    weights = _train(learned, given, fold, n_all)
    given.destroy()
    return found, weights, n_all, v_all


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``train`` chooses the training rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    learned = rows.where("train")
    counts = cut_lineage(count_tokens(learned, "text"))
    found, fitted, n_all, v_all = fit(learned, counts, F.xxhash64(F.lit("fold"), F.col("doc_id")))
    model = spark.sparkContext.broadcast((found, fitted))
    least, base = found.least, math.log10(n_all + v_all + 1)

    def run(batches):
        for b in batches:
            for first, texts in runs(b.column(0)):
                begin, (ids, *known) = coded(texts, model.value[0].look)
                inner, c = log_probability(*model.value, ids, begin, known)
                logs = np.log10(c + 1.0)
                n = np.diff(begin)
                # Rare tokens get their log10(c + 1) by the join, for both scores.
                own = sums(inner - np.where(c > 0, logs, 0), begin)
                row = b.column(1).slice(first, len(texts)).to_numpy()
                # One row a text for what is known here, and one for each of its different rare tokens.
                rare = np.flatnonzero(c == 0)
                pair = np.repeat(row, n)[rare]
                key = ids[rare]
                order = np.lexsort((key, pair))
                pair, key = pair[order], key[order]
                new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])])) if len(pair) else np.zeros(0, np.int64)
                many = np.diff(np.append(new, len(pair)))
                zero = np.zeros(len(new))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([row, pair[new]])),
                        pa.array(np.concatenate([np.zeros(len(row), np.int64), many])),
                        pa.array(np.concatenate([row, key[new].view(np.int64)])),
                        pa.array(np.concatenate([n, zero.astype(np.int64)])),
                        pa.array(np.concatenate([sums((c > 0).astype(float), begin).astype(np.int64), zero.astype(np.int64)])),
                        pa.array(np.concatenate([sums(logs, begin), zero])),
                        pa.array(np.concatenate([own, zero])),
                        pa.concat_arrays([b.column(2).slice(first, len(texts)), pa.nulls(len(new), b.column(2).type)]),
                        pa.concat_arrays([b.column(3).slice(first, len(texts)), pa.nulls(len(new), pa.bool_())]),
                    ],
                    ["row", "tf", "h", "n", "known", "logs", "own", "doc_id", "train"],
                )

    numbered = rows.select("text", F.monotonically_increasing_id().alias("row"), "doc_id", "train")
    schema = T.StructType([T.StructField(k, v) for k, v in zip(("row", "tf", "h", "n", "known", "logs", "own"), [T.LongType()] * 5 + [T.DoubleType()] * 2)])
    told = numbered.mapInArrow(run, schema.add(numbered.schema["doc_id"]).add("train", T.BooleanType()))
    tail = counts.where(F.col("c") < least)
    met = told.join(tail, "h", "left").withColumn("c", F.when(F.col("tf") > 0, F.col("c")))
    summed = met.groupBy("row").agg(
        F.sum("n").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("logs") + F.sum(F.coalesce(F.col("tf") * F.log10(F.col("c") + 1), F.lit(0.0)))).alias("logs"),
        F.sum("own").alias("own"),
        F.max("doc_id").alias("doc_id"),
        F.max("train").alias("train"),
    )
    return summed.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("logs") + F.col("own")).alias("score"),
    )
