"""Evaluation metrics as grouped aggregates and windows over decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .ranks import running


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 on a zero denominator."""
    return _ratio(2 * tp, 2 * tp + fp + fn)


def confusion(decisions: DataFrame, keys: list[str], target: str = "target", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn by key; a decision is positive at the threshold or above."""
    yes, real = F.col(score) >= threshold, F.col(target) == 1
    return decisions.groupBy(*keys).agg(F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn"), F.count_if(~yes & ~real).alias("tn"))


def multilabel_f1(decisions: DataFrame, label: str, **how) -> DataFrame:
    """One row: macro and micro F1 over the labels."""
    each = confusion(decisions, [label], **how).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return each.agg(F.avg("f1").alias("macro_f1"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.count("*").alias("labels"))


def average_precision(decisions: DataFrame, key: str, target: str = "target", score: str = "score") -> DataFrame:
    """Step-wise average precision with tied scores taken together; 0 without positives.

    Rows are counted by (key, score) first. The sums down the scores run over the table of all keys, in ranges of it
    (``ranks.running``), less what the keys before hold: a key of very many scores takes several tasks.
    """
    tied = decisions.groupBy(key, score).agg(F.sum(target).cast("long").alias("tp"), F.count("*").alias("n"))
    run = running(tied, [F.col(key).asc(), F.col(score).desc()], {"ctp": F.col("tp"), "cn": F.col("n")})
    before = run.groupBy(F.col(key).alias("_k")).agg(F.min(F.col("ctp") - F.col("tp")).alias("_tp"), F.min(F.col("cn") - F.col("n")).alias("_n"), F.sum("tp").alias("_all"))
    met = run.join(before, F.col(key).eqNullSafe(F.col("_k")))
    gain = F.try_divide(F.col("tp"), F.col("_all")) * (F.col("ctp") - F.col("_tp")) / (F.col("cn") - F.col("_n"))
    return met.groupBy(key).agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("ap"))


def paired_correctness(a: Column, b: Column, target: Column) -> list[Column]:
    """Aggregates of the 2 x 2 table of two systems' correctness."""
    x, y = a == target, b == target
    return [F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(~x & ~y).alias("neither")]


def win_tie(a: Column, b: Column) -> list[Column]:
    return [F.count_if(a > b).alias("wins"), F.count_if(a < b).alias("losses"), F.count_if(a == b).alias("ties")]


def sample_f1(truth: Column, found: Column) -> Column:
    """Set F1 of two label arrays of a row; 0 if both are empty."""
    both = F.size(F.array_intersect(truth, found))
    return _ratio(2 * both, F.size(truth) + F.size(found))


def best_detection(candidates: Column, threshold: float, max_area: float | None = None) -> Column:
    """The first of the greatest score among those at the threshold and below the area cap; null if none is left."""
    kept = F.filter(candidates, lambda c: (c["score"] >= threshold) & (F.lit(True) if max_area is None else c["area"] < max_area))
    best = F.array_max(F.transform(kept, lambda c: c["score"]))
    return F.get(F.filter(kept, lambda c: c["score"] == best), F.lit(0))


def grounding_summary(rows: DataFrame, keys: list[str], iou: str = "iou", huge: str = "huge") -> DataFrame:
    """Mean IoU (no detection counts 0), accuracy at .5, detections missing, mean of the detected, huge boxes."""
    v = F.coalesce(F.col(iou), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.avg(v).alias("mean_iou"), F.avg((v >= 0.5).cast("double")).alias("acc_50"), F.count_if(F.col(iou).isNull()).alias("no_detection"), F.avg(iou).alias("detected_mean"), F.count_if(F.coalesce(F.col(huge), F.lit(False))).alias("huge"), F.count("*").alias("n")
    )


def choose_threshold(summary: DataFrame) -> DataFrame:
    """The row of greatest (acc_50, mean_iou, -no_detection, threshold)."""
    return summary.orderBy(F.col("acc_50").desc(), F.col("mean_iou").desc(), F.col("no_detection").asc(), F.col("threshold").desc()).limit(1)


def majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value by key; ties go to the one that came first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias("majority"))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """Counts and shares of a value, the most frequent first."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))  # one row
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def exact_match(rows: DataFrame, kind: str, expected: Column, predicted: Column) -> DataFrame:
    """Share of equal answers by kind, in normal form."""
    return rows.groupBy(kind).agg(F.avg(expected.eqNullSafe(predicted).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of two tables, how many both have, and the share of the second's rows whose key the first has."""
    seen = b.join(a.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    both = seen.agg(F.countDistinct(key).alias("second_keys"), F.countDistinct(F.when(F.col("_seen"), F.col(key))).alias("shared_keys"), F.avg(F.col("_seen").isNotNull().cast("double")).alias("seen_share"))
    return a.agg(F.countDistinct(key).alias("first_keys")).crossJoin(both)


def metric_deltas(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, first, second, delta, change): a metric of two systems side by side."""
    met = a.select(key, F.col(metric).alias("first")).join(b.select(key, F.col(metric).alias("second")), key)
    met = met.withColumn("delta", F.col("second") - F.col("first"))
    return met.withColumn("change", F.when(F.col("delta") > 0, "improved").when(F.col("delta") < 0, "worse").otherwise("equal"))


def running_best(rows: DataFrame, key: str, order: str, metric: str, patience: int | None = None, min_delta: float = 0.0) -> DataFrame:
    """(key, best, best_at, stopped_at): the best metric up to where more than ``patience`` rows in order brought no better one.

    Better is greater than the best so far by more than ``min_delta``; null metrics are never better. A key's rows are a
    run of training or of a job, folded in order within its row.
    """
    kind, at = rows.schema[metric].dataType.simpleString(), rows.schema[order].dataType.simpleString()
    run = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(metric).alias("m")))).alias("_run"))
    none = lambda t: F.lit(None).cast(t)
    start = F.struct(none(kind).alias("best"), none(at).alias("best_at"), F.lit(0).alias("stale"), none(at).alias("stopped_at"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        better = F.coalesce(s["best"].isNull() & x["m"].isNotNull() | (x["m"] > s["best"] + F.lit(min_delta)), F.lit(False))
        stale = F.when(better, 0).otherwise(s["stale"] + 1)
        done = F.lit(False) if patience is None else stale > patience
        new = F.struct(F.when(better, x["m"]).otherwise(s["best"]).alias("best"), F.when(better, x["at"]).otherwise(s["best_at"]).alias("best_at"), stale.alias("stale"), x["at"].alias("stopped_at"), done.alias("done"))
        return F.when(s["done"], s).otherwise(new)

    return run.withColumn("_s", F.aggregate("_run", start, step)).select(key, "_s.best", "_s.best_at", "_s.stopped_at")


def visual_dependence(rows: DataFrame, keys: list[str], answer: str = "answer", correct: str = "correct", blank: str = "blank", shuffled: str = "shuffled") -> DataFrame:
    """``keys``, n, the accuracy of answers with the right image, a blank one and another scene's, gap, differing, correct_wins, shuffled_wins.

    Answers are compared in normal form; the gap is the first accuracy less the better of the others."""
    plain = rows.select(*keys, *(normalize_text(F.col(c)).alias(k) for k, c in (("a", answer), ("c", correct), ("b", blank), ("s", shuffled))))
    right = lambda k: F.col(k).eqNullSafe(F.col("a"))
    found = plain.groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.avg(right(k).cast("double")).alias(name) for k, name in (("c", "correct"), ("b", "blank"), ("s", "shuffled"))),
        F.count_if(~F.col("c").eqNullSafe(F.col("s"))).alias("differing"), F.count_if(right("c") & ~right("s")).alias("correct_wins"), F.count_if(~right("c") & right("s")).alias("shuffled_wins"),
    )
    return found.withColumn("gap", F.col("correct") - F.greatest("blank", "shuffled"))


#: Fixed value: the gain of the gap that counts as an improvement.
MATERIAL_GAIN = 0.05


def materially_improved(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, gain, improved: the gap of a candidate against a baseline's (both of ``visual_dependence``)."""
    met = baseline.select(*keys, F.col("gap").alias("_before")).join(candidate.select(*keys, F.col("gap").alias("_after")), keys)
    return met.select(*keys, (F.col("_after") - F.col("_before")).alias("gain")).withColumn("improved", F.col("gain") >= MATERIAL_GAIN)
