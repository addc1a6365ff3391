"""Toxicity by class-conditional Kneser-Ney models.

Words are coded by hash into ``BUCKETS`` codes, and a model is a distribution over codes. Both classes, toxic and
ordinary, have a bigram model over document counts (a pair counts once a document):

    P_c(w | h) = max(n_c(h, w) - D_c, 0) / n_c(h) + left_c(h) * P_c(w)
    P_c(w)     = max(n_c(w) - D_c, 0) / n_c       + left_c    * shared(w)
    shared(w)  = (number of different h before w in either class + UNSEEN), in proportion

D_c is the Kneser-Ney discount of the class, n1 / (n1 + 2 n2) from its pairs seen once and twice, so below 1; left_c is
all mass that the terms before it leave, so each model sums to one (tested). Own counts of a word or pair are kept from
``SUPPORT`` counts of both classes together on, and contexts from as many in each class: a threshold apart from the
discount, and the same at every size. The mass of all others goes to what is left, so that rare expressions count by
what both classes share.

A document's score compares both log-likelihoods, normalised by length: the mean difference a word, and the greatest
mean, over a passage of ``PASSAGE`` words, of what exceeds ``CLEAR`` (a few clear expressions in a long text, but not a
faint one said over and over). A logistic fit on labelled documents that the counts have not seen puts both on a scale
of 0 to 1; its rows weigh as many documents as they were drawn from, so the mix of classes is the true one at every size.

Fitting uses at most ``MAX_DOCS`` labelled documents a class for the counts and as many for the scale, taken by the
hash of their ids. Counts are aggregated in Spark; of the pairs that fall into one of ``BUCKETS`` slots the best supported one is
kept there, in Spark too, so that the driver gets at most ``BUCKETS`` rows of each table. Scoring is one narrow pass.

Defined results: words are as in decontamination (letters and digits, lower case); null and empty texts have no word
and get the score of no evidence; without labelled documents of both classes every score is the share of toxic ones
(0 without any). Documents with several labels are fitted by the largest; rows repeated under one id are fitted as
often as they are there; equal rows get equal scores. A long text is scored whole. Further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, written
from .tokens import FOLD, Hashes, hashed, slices, sums

MAX_DOCS = 20_000
BITS = 19
BUCKETS = 1 << BITS
SUPPORT = 20
PASSAGE = 10
CLEAR = 1.5
UNSEEN = 0.1  # a code's share of the shared counts where it never was
THRESHOLD = 0.7
_MIX = np.uint64(0x9E3779B97F4A7C15)


def coded(texts: list[bytes], memo: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, of the words before them (0 at a text's start; no word has the code 0), and where texts begin."""
    ids, begin = hashed([t.translate(FOLD).split() for t in texts], memo)
    w = ((ids ^ (ids >> np.uint64(32))) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    h = np.concatenate([np.zeros(1, np.int64), w[:-1]]) if len(w) else w
    h[begin[:-1][begin[:-1] < len(w)]] = 0
    return w, h, begin


def slot(pair: np.ndarray) -> np.ndarray:
    return ((pair.astype(np.uint64) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _sample(labels: DataFrame, chosen: Column, doc_id: str, label: str, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, y): about ``most`` rows a class at the most, by hash of the id; and how many documents a row stands for."""
    rows = labels.where(chosen & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_tx_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("_tx_y"))
    sizes = {r["_tx_y"]: r["count"] for r in rows.groupBy("_tx_y").count().collect()}
    share = {y: min(1.0, most / max(1, sizes.get(y, 0))) for y in (0, 1)}
    part = F.when(F.col("_tx_y") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "_tx_id"), F.lit(1 << 20)) < part * (1 << 20)), {y: 1 / share[y] for y in (0, 1)}


class Model:
    """Both models as arrays over codes and pair slots; scale: the logistic fit."""

    def __init__(self, words: dict[str, np.ndarray], contexts: dict[str, np.ndarray], pairs: dict[str, np.ndarray], discounts: tuple[float, float]):
        """words: n0, n1, follows by code; contexts: n0, n1 by code; pairs: pair, n0, n1, each of a slot of its own."""
        shared = (words["follows"] + UNSEEN) / (words["follows"].sum() + UNSEEN * BUCKETS)
        self.key = np.full(BUCKETS, -1, np.int64)
        at = slot(pairs["pair"])
        self.key[at] = pairs["pair"]
        often = words["n0"] + words["n1"] >= SUPPORT
        h = pairs["pair"] >> BITS
        known = np.minimum(contexts["n0"], contexts["n1"])[h] >= SUPPORT
        self.word, self.pair, self.left = [], [], []
        for c in (0, 1):
            own = np.where(often, np.maximum(words[f"n{c}"] - discounts[c], 0), 0) / max(words[f"n{c}"].sum(), 1.0)
            self.word.append((own + (1 - own.sum()) * shared).astype(np.float32))
            kept = np.where(known, np.maximum(pairs[f"n{c}"] - discounts[c], 0), 0) / np.maximum(contexts[f"n{c}"], 1)[h]
            self.pair.append(np.zeros(BUCKETS, np.float32))
            self.pair[c][at] = kept
            self.left.append((1 - np.bincount(h, weights=kept, minlength=BUCKETS)).astype(np.float32))
        self.scale = np.zeros(3)

    def probability(self, c: int, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        pair = (h << BITS) | w
        at = slot(pair)
        return np.where(self.key[at] == pair, self.pair[c][at], np.float32(0)) + self.left[c][h] * self.word[c][w]

    def features(self, texts: list[bytes], memo: Hashes) -> np.ndarray:
        """Of each text the mean difference a word, and the greatest mean of clear ones over a passage."""
        w, h, begin = coded(texts, memo)
        ratio = np.log(self.probability(1, w, h)).astype(np.float64) - np.log(self.probability(0, w, h))
        n = np.diff(begin)
        mean = sums(ratio, begin) / np.maximum(n, 1)
        clear, last = np.maximum(ratio - CLEAR, 0), np.repeat(begin[1:], n)
        # A passage at the end of a text is shorter: its sum is taken over the whole length all the same.
        passage, first = np.zeros(len(ratio)), np.arange(len(ratio))
        for j in range(PASSAGE):
            inside = np.flatnonzero(first + j < last)
            passage[inside] += clear[inside + j] / PASSAGE
        best = np.zeros(len(n))
        some = np.flatnonzero(n)
        if len(some):
            best[some] = np.maximum.reduceat(passage, begin[:-1][some])
        return np.stack([mean, best], axis=1)

    def score(self, texts: list[bytes], memo: Hashes) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts, memo) @ self.scale[:-1] + self.scale[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: intercept) over standardised columns, given back for the plain ones."""
    weight = np.ones(len(y)) if weight is None else weight
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, z.T @ (weight * (p - y)) + ridge * np.append(w[:-1], 0))
    plain = w[:-1] / std
    return np.append(plain, w[-1] - plain @ mean)


def _dense(df: DataFrame, key: str, *names: str) -> dict[str, np.ndarray]:
    got, out = df.toArrow(), {}
    for name in names:
        out[name] = np.zeros(BUCKETS)
        out[name][got.column(key).to_numpy()] = got.column(name).to_numpy()
    return out


def fit(docs: DataFrame, text: str, fitted: DataFrame, doc_id: str) -> Model:
    """Both models from the rows of ``docs`` that ``fitted`` (_tx_id, _tx_y) names."""
    rows = docs.select(F.col(doc_id).alias("_tx_id"), F.col(text).alias("t")).join(F.broadcast(fitted), "_tx_id").select("t", "_tx_y")

    def count(batches):
        memo = Hashes()
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for first, texts in slices(b.column(0)):
                w, h, begin = coded(texts, memo)
                doc = np.repeat(np.arange(len(texts)), np.diff(begin))
                pair = (h << BITS) | w
                # Each pair once a document, then the documents of the run by class.
                order = np.lexsort((doc, pair))
                new = np.concatenate([[True], (np.diff(pair[order]) != 0) | (np.diff(doc[order]) != 0)])[: len(pair)]
                one = order[new]
                at, inverse = np.unique(pair[one], return_inverse=True)
                n1 = np.bincount(inverse, weights=label[first : first + len(texts)][doc[one]], minlength=len(at)).astype(np.int32)
                n0 = np.bincount(inverse, minlength=len(at)).astype(np.int32) - n1
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n0), pa.array(n1)], ["pair", "n0", "n1"])

    counted = rows.mapInArrow(count, "pair long, n0 int, n1 int").groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    pairs, path = written(counted, "toxicity_pairs")
    w, h = F.col("pair").bitwiseAND(BUCKETS - 1).cast("int"), F.shiftright("pair", BITS).cast("int")
    words = _dense(pairs.groupBy(w.alias("w")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("follows")), "w", "n0", "n1", "follows")
    contexts = _dense(pairs.groupBy(h.alias("h")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "h", "n0", "n1")
    once = pairs.agg(*(F.count_if(F.col(f"n{c}") == k).alias(f"c{c}{k}") for c in (0, 1) for k in (1, 2))).first()

    def slots(batches):
        """Of the pairs of a run that fall into one slot the best supported one."""
        for b in batches:
            pair, n = b.column(0).to_numpy(), b.column(1).to_numpy() + b.column(2).to_numpy()
            at = slot(pair)
            order = np.lexsort((pair, -n, at))
            keep = order[np.concatenate([[True], np.diff(at[order]) != 0])[: len(order)]]
            yield pa.RecordBatch.from_arrays([pa.array(at[keep].astype(np.int32)), *(c.take(pa.array(keep)) for c in b.columns)], ["slot", *b.schema.names])

    slotted = pairs.where(F.col("n0") + F.col("n1") >= SUPPORT).mapInArrow(slots, "slot int, pair long, n0 long, n1 long")
    best = slotted.groupBy("slot").agg(F.max(F.struct(F.col("n0") + F.col("n1"), -F.col("pair"), "n0", "n1")).alias("x")).select((-F.col("x.col2")).alias("pair"), "x.n0", "x.n1").toArrow()
    discard(docs.sparkSession, path)
    discounts = tuple(once[f"c{c}1"] / max(1, once[f"c{c}1"] + 2 * once[f"c{c}2"]) for c in (0, 1))
    return Model(words, contexts, {k: best.column(k).to_numpy() for k in ("pair", "n0", "n1")}, discounts)


def score(docs: DataFrame, labels: DataFrame, fit_rows: Column, scale_rows: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", out: str = "toxicity", most: int = MAX_DOCS) -> DataFrame:
    """``docs`` and ``out``, the score. ``fit_rows`` and ``scale_rows`` choose the label rows for the counts and for the scale."""
    out, sc = fresh(docs, out), docs.sparkSession.sparkContext
    (fitted, _), (scaled, stands_for) = (_sample(labels, rows, doc_id, label, most) for rows in (fit_rows, scale_rows))
    toxic, n = fitted.agg(F.coalesce(F.sum("_tx_y"), F.lit(0)), F.count("*")).first()
    model = None
    if 0 < toxic < n:
        found = fit(docs, text, fitted, doc_id)
        given = sc.broadcast(found)

        def features(batches):
            memo = Hashes()
            for b in batches:
                for first, texts in slices(b.column(0)):
                    x = given.value.features(texts, memo)
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), b.column(1).slice(first, len(texts))], ["a", "b", "y"])

        rows = docs.select(F.col(doc_id).alias("_tx_id"), F.col(text).alias("t")).join(F.broadcast(scaled), "_tx_id").select("t", "_tx_y")
        got = rows.mapInArrow(features, "a double, b double, y int").toArrow()
        y = got.column("y").to_numpy()
        if 0 < y.sum() < len(y):
            found.scale = logistic(np.column_stack([got.column(c).to_numpy() for c in "ab"]), y, np.where(y == 1, stands_for[1], stands_for[0]))
            model = sc.broadcast(found)
        given.unpersist()
    share, at = toxic / n if n else 0.0, docs.columns.index(text)

    def scored(batches):
        memo = Hashes()
        for b in batches:
            value = [np.zeros(0)]
            for _, texts in slices(b.column(at)):
                value.append(np.full(len(texts), share) if model is None else model.value.score(texts, memo))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(value))], [*b.schema.names, out])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)]))
