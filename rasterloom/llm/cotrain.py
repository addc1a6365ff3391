"""Quality classifier by co-training of two views that share no input.

* Content: hashed words and word endings of the text (``BUCKETS`` buckets), log-odds averaged over the text, and the
  text's shape (case, marks, lengths of words and lines, in bins), log-odds summed.
* Page metadata: the columns named (language, source, recorded length), hashed by value, numbers by half powers of two;
  log-odds weighed by column. It never reads the text.

Each view is a naive Bayes model whose log-odds a logistic fit on labelled rows calibrates. In each of ``ROUNDS``
rounds all documents are scored by both views, and each view gives the *other* one pseudo-labels for its surest
documents of either class: those beyond the calibrated log-odds that bound its surest ``SHARE`` of the labelled rows
(ties included), unless the other view contradicts with a probability beyond ``AGAINST``. A pseudo-label weighs up to
``PSEUDO``, by the square of how far the view's probability is on the way from the share of good rows to certainty: a
view that knows nothing teaches nothing, and one that knows little teaches little.
Labelled rows always count for both. Half of the labelled rows are counted, a quarter calibrates, and a quarter, which
did neither, judges: the views of a round stay only if their log-loss (of the combination) is within ``SLACK`` of that
before; else the rounds end. A last pass scores every document by a fit of both views over both quarters.

A round is one narrow pass that returns counts by bucket, summed by bucket in Spark: fixed size, whatever the corpus.
Calibration takes at most ``MAX_DOCS`` labelled rows by hash of their ids; so do the labelled counts of round 0.

Defined results: null texts are empty; null metadata are values of their own; without labelled rows of
both classes every score is the share of good ones (0.5 without any). Documents with several labels take the least.
Equal rows get equal scores, rows repeated under one id count as often; a very long text is scored whole; an empty
table gives an empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .tokens import slices, sums
from .toxicity import logistic

BUCKETS = 1 << 16
META = 1 << 12
ROUNDS = 2
SHARE = 0.15  # of either class, a view and a round
AGAINST = 0.8
SLACK = 0.002  # nats a row
PSEUDO = 0.5
MAX_DOCS = 20_000
KEEP = 0.5
METADATA = ("lang", "source", "n_chars")


class Codes(dict):
    """Word to the buckets of the word and of its last two bytes, in one number; forgets all at ``most`` words."""

    def __init__(self, most: int = 1 << 19):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = (xxhash.xxh32_intdigest(word) % BUCKETS) << 16 | xxhash.xxh32_intdigest(word[-2:], 1) % BUCKETS
        return value


def content(texts: list[bytes], memo: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their endings, one after the other, and where texts begin."""
    split = [t.split() for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in split], dtype=np.int64)])
    both, look = np.empty(int(begin[-1]), np.uint32), memo.__getitem__
    for t, at in zip(split, begin.tolist()):
        both[at : at + len(t)] = list(map(look, t))
    return np.stack([both >> 16, both & 0xFFFF], axis=1).ravel().astype(np.int64), begin * 2


def shape(texts: list[bytes], words: np.ndarray, memo: Codes) -> np.ndarray:
    """Buckets (texts, figures) of the text's shape."""
    rows = []
    for t, k in zip(texts, words.tolist()):
        n = len(t)
        upper, lower = (sum(map(t.count, x)) for x in ((b"A", b"E", b"I", b"N", b"T"), (b"a", b"e", b"i", b"n", b"t")))
        marks, lines = sum(map(t.count, (b"!", b"#", b"$", b"%", b"&", b"*", b"|"))), t.count(b"\n") + 1
        values = (int(np.log2(k + 1) * 2), int(np.log2(lines) * 2), int(8 * upper / (upper + lower + 1)), int(np.log2(1 + 1000 * marks / (n + 1))), min(30, n // (k + 1)), min(20, n // lines // 50))
        rows.append([(memo[b"%d=%d" % (i, v)] >> 16) % META for i, v in enumerate(values)])
    return np.array(rows, np.int64).reshape(len(texts), -1)


def metadata(docs: DataFrame, names: tuple[str, ...]) -> Column:
    """Buckets of the named columns' values: array<int>."""
    fields = []
    for i, name in enumerate(names):
        c = F.col(f"`{name}`")
        if isinstance(docs.schema[name].dataType, T.NumericType):
            c = F.floor(2 * F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1))
        fields.append(F.pmod(F.xxhash64(F.lit(i), c.isNull(), c.cast("string")), F.lit(META)).cast("int"))
    return F.array(*fields)


class Views:
    """Log-odds tables of both views, their calibrations and the fit over both."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray, meta: np.ndarray):
        self.words, self.shapes, self.meta = _odds(words), _odds(shapes), _odds(meta)
        # Slopes and intercept of content (words, shape) and of metadata (each column; its odds until it is calibrated).
        self.fits = [np.array([1.0, 1.0, 0.0]), None]
        self.both = np.array([0.5, 0.5, 0.0])
        self.good, self.sure = 0.5, np.array([[-np.inf, np.inf]] * 2)  # share of good rows; of each view: its surest bad, good
        self.loss = np.inf

    def raw(self, texts: list[bytes], fields: np.ndarray, memo: Codes):
        """Log-odds of words, shape and each column of metadata; buckets of words, where texts begin in them, and of shapes."""
        at, begin = content(texts, memo)
        form = shape(texts, np.diff(begin) // 2, memo)
        odds = sums(self.words[at], begin) / np.maximum(np.diff(begin), 1)
        return np.column_stack([odds, self.shapes[form].sum(axis=1), self.meta[fields]]), at, begin, form

    def logits(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated, of content and of metadata."""
        meta = self.fits[1] if self.fits[1] is not None else np.append(np.ones(raw.shape[1] - 2), 0.0)
        own = raw[:, :2] @ self.fits[0][:2] + self.fits[0][2], raw[:, 2:] @ meta[:-1] + meta[-1]
        return np.clip(np.stack(own, axis=1), -8, 8)

    def score(self, raw: np.ndarray) -> np.ndarray:
        z = self.logits(raw)
        return 1 / (1 + np.exp(-np.clip(z @ self.both[:2] + self.both[2], -30, 30)))


    def settle(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Calibrates both views and their combination on labelled rows, and finds where each view's surest share begins."""
        if not 0 < y.sum() < len(y):
            return
        self.fits = [logistic(raw[:, :2], y), logistic(raw[:, 2:], y)]
        z = self.logits(raw)
        self.good, self.sure = float(y.mean()), np.quantile(z, [SHARE, 1 - SHARE], axis=0).T
        self.both = logistic(z, y)
        for own in (0, 1):
            # A view that would count against its own verdict is left out.
            if self.both[own] < 0:
                self.both = np.insert(logistic(z[:, [1 - own]], y), own, 0.0)


def _odds(counts: np.ndarray) -> np.ndarray:
    """log P(bucket | good) - log P(bucket | bad), each smoothed by the buckets' overall share."""
    share = (counts.sum(axis=1) + 0.5) / (counts.sum() + 0.5 * len(counts))
    strength = 10.0
    p = [(counts[:, y] + strength * share * len(counts) / 64) / (counts[:, y].sum() + strength * len(counts) / 64) for y in (0, 1)]
    return np.log(p[1]) - np.log(p[0])


def _fields(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), -1).astype(np.int64) if len(col) else np.zeros((0, 1), np.int64)


_TABLES = (BUCKETS, META, META)  # words, shapes, metadata


def _sums(rows: DataFrame, run) -> list[np.ndarray]:
    got = rows.mapInArrow(run, "view int, at int, bad double, good double").groupBy("view", "at").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    view, at = got.column("view").to_numpy(), got.column("at").to_numpy()
    counts = np.column_stack([got.column("bad").to_numpy(), got.column("good").to_numpy()])
    out = [np.zeros((size, 2)) for size in _TABLES]
    for k, table in enumerate(out):
        table[at[view == k]] = counts[view == k]
    return out


def _told(tables: list[np.ndarray]) -> pa.RecordBatch:
    at = [np.flatnonzero(t.any(axis=1)) for t in tables]
    rows = np.concatenate([t[x] for t, x in zip(tables, at)])
    view = np.repeat(np.arange(len(tables)), list(map(len, at)))
    return pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["view", "at", "bad", "good"])


def exchanged(views: Views, z: np.ndarray) -> list[np.ndarray]:
    """Pseudo-label weights (bad, good) for the content and for the metadata view, from both views' calibrated log-odds.

    Weights are multiples of 1/64, so that their sums do not depend on an order."""
    p, out = 1 / (1 + np.exp(-z)), []
    for own, other in ((0, 1), (1, 0)):
        low, high = views.sure[other]
        bad = (z[:, other] <= low) & (p[:, own] <= AGAINST)
        good = (z[:, other] >= high) & (p[:, own] >= 1 - AGAINST)
        told = np.column_stack([bad * (views.good - p[:, other]) / views.good, good * (p[:, other] - views.good) / (1 - views.good)])
        out.append(np.round(np.clip(told, 0, 1) ** 2 * PSEUDO * 64) / 64)
    return out


def _counter(views):
    """Counts of a pass over (t, m, y): y is -1 where a row has no label. Without views all rows have one."""

    def run(batches):
        memo, tables = Codes(), [np.zeros((size, 2)) for size in _TABLES]
        for b in batches:
            fields, label = _fields(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            for first, texts in slices(b.column(0)):
                part = slice(first, first + len(texts))
                y, m = label[part], fields[part]
                to_content = to_meta = np.column_stack([y == 0, y == 1]).astype(float)
                if views is None:
                    at, begin = content(texts, memo)
                    form = shape(texts, np.diff(begin) // 2, memo)
                else:
                    raw, at, begin, form = views.value.raw(texts, m, memo)
                    told = exchanged(views.value, views.value.logits(raw))
                    to_content, to_meta = (np.where((y < 0)[:, None], x, to_content) for x in told)
                for table, where, weight, each in ((tables[0], at, to_content, np.diff(begin)), (tables[1], form.ravel(), to_content, form.shape[1]), (tables[2], m.ravel(), to_meta, m.shape[1])):
                    for c in (0, 1):
                        if weight[:, c].any():
                            table[:, c] += np.bincount(where, weights=np.repeat(weight[:, c], each), minlength=len(table))
        yield _told(tables)

    return run


def score(docs: DataFrame, labels: DataFrame, fit: Column, doc_id: str = "doc_id", text: str = "text", meta: tuple[str, ...] = METADATA, label: str = "quality", out: str = "quality_score", rounds: int = ROUNDS, most: int = MAX_DOCS) -> DataFrame:
    """``docs`` and ``out`` (0 to 1, higher: better). ``fit`` chooses the label rows to learn from, ``meta`` names the metadata."""
    sc, out = docs.sparkSession.sparkContext, fresh(docs, out)
    known = labels.where(fit & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_co_id")).agg(F.min((F.col(label) > 0).cast("int")).alias("_co_y"))
    total = known.count()
    known = known.where(F.pmod(F.xxhash64(F.lit("quality"), "_co_id"), F.lit(1 << 20)) < min(1.0, most / max(1, total)) * (1 << 20))
    good, n = known.agg(F.coalesce(F.sum("_co_y"), F.lit(0)), F.count("*")).first()
    final = None
    fields = metadata(docs, meta)
    if 0 < good < n:
        # Counts would look too sure of their own rows: even quarters are counted, one calibrates and one judges.
        quarters = known.withColumn("part", F.pmod(F.xxhash64(F.lit("half"), "_co_id"), F.lit(4)))
        named = docs.select(F.col(text).alias("t"), fields.alias("m"), F.col(doc_id).alias("_co_id")).join(F.broadcast(quarters), "_co_id", "left")
        rows = named.select("t", "m", F.when(F.col("part") % 2 == 0, F.col("_co_y")).when(F.col("part") % 2 == 1, F.lit(-2)).otherwise(F.lit(-1)).alias("y"))
        check = named.where("part % 2 = 1").select("t", "m", F.col("_co_y").alias("y"), (F.col("part") == 3).alias("judge"), F.col("_co_id").cast("string").alias("id"))
        views, told = _fitted(Views(*_sums(rows.where("y >= 0"), _counter(None))), check, sc)
        for _ in range(rounds):
            given = sc.broadcast(views)
            following, told_then = _fitted(Views(*_sums(rows.where("y > -2"), _counter(given))), check, sc)
            given.unpersist()
            if following.loss > views.loss + SLACK:
                break
            views, told = following, told_then
        views.settle(*told)
        final = sc.broadcast(views)
    share, at, named_at = good / n if n else 0.5, docs.columns.index(text), fresh(docs, "_co_fields")

    def scored(batches):
        memo = Codes()
        for b in batches:
            m, value = _fields(b.column(len(b.columns) - 1)), [np.zeros(0)]
            for first, texts in slices(b.column(at)):
                value.append(np.full(len(texts), share) if final is None else final.value.score(final.value.raw(texts, m[first : first + len(texts)], memo)[0]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(value))], [*b.schema.names[:-1], out])

    return docs.withColumn(named_at, fields).mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)]))


def _fitted(views: Views, check: DataFrame, sc) -> tuple[Views, tuple]:
    """Calibrates both views and their combination on the rows of ``check`` that do not judge, and takes the loss of
    those that do; also these rows: raw log-odds and labels. One row an id comes to the driver."""
    given = sc.broadcast(views)

    def run(batches):
        memo = Codes()
        for b in batches:
            fields = _fields(b.column(1))
            for first, texts in slices(b.column(0)):
                raw = given.value.raw(texts, fields[first : first + len(texts)], memo)[0]
                yield pa.RecordBatch.from_arrays([pa.array(raw.tolist(), pa.list_(pa.float64())), *(b.column(i).slice(first, len(texts)) for i in (2, 3, 4))], ["raw", "y", "judge", "id"])

    each = check.mapInArrow(run, "raw array<double>, y int, judge boolean, id string")
    got = each.groupBy("id").agg(F.max(F.struct("raw", "y", "judge")).alias("x")).select("id", "x.*").orderBy("id").toArrow()
    given.unpersist()
    y, judge = (got.column(c).to_numpy() for c in ("y", "judge"))
    if not len(y):
        return views, (np.zeros((0, 2)), y)
    raw, judge = np.array(got.column("raw").to_pylist()), judge.astype(bool)
    views.settle(raw[~judge], y[~judge])
    if judge.any():
        p = np.clip(views.score(raw[judge]), 1e-6, 1 - 1e-6)
        views.loss = -float(np.mean(np.where(y[judge] == 1, np.log(p), np.log(1 - p))))
    return views, (raw, y)
