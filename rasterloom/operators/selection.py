"""Dataset selection: splits, leakage, balanced and bounded samples, greedy coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tie_hash


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def first_groups(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Rows of the ``n`` groups that appear first."""
    first = df.groupBy(key).agg(F.min(order).alias("_first")).orderBy("_first", key).limit(n)
    return df.join(first.select(key), key, "left_semi")


def round_robin(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first of each group, then the second of each, and so on, up to ``most`` rows."""
    depth = df.withColumn("depth", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return depth.orderBy("depth", key).limit(most)


def assign_split(df: DataFrame, key: str, seed: str, percents: tuple[int, int]) -> DataFrame:
    """train, validation or test of each key by its rank in seeded hash order (rows of a key stay together).

    Ranks come from the number of keys with a smaller hash prefix (a small histogram) and the rank within the prefix,
    so no task sees all keys.
    """
    keys = df.select(key).distinct().withColumn("_h", tie_hash(seed, F.col(key).cast("string")))
    keys = keys.withColumn("_b", F.substring("_h", 1, 3))
    sizes = keys.groupBy("_b").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_c"))
    before = before.withColumn("_all", F.sum("_c").over(W.partitionBy()))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) + F.col("_before") - 1
    placed = keys.join(F.broadcast(before), "_b").withColumn("_r", rank)
    a, b = percents
    part = F.when(F.col("_r") * 100 < F.col("_all") * a, "train").when(F.col("_r") * 100 < F.col("_all") * (a + b), "validation").otherwise("test")
    return df.join(placed.select(key, part.alias("split")), key)


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that are in more than one split: no rows means none leaks."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def balance_by_cycling(df: DataFrame, group: str, bucket: str, order: str) -> DataFrame:
    """Every bucket of a group is repeated in order, cyclically, to the size of the group's largest bucket."""
    sizes = df.groupBy(group, bucket).agg(F.count("*").alias("_n"))
    most = sizes.groupBy(group).agg(F.max("_n").alias("_most"))
    ranked = df.withColumn("_i", F.row_number().over(W.partitionBy(group, bucket).orderBy(order)) - 1)
    met = ranked.join(sizes, [group, bucket]).join(most, group)
    copies = F.expr("(_most - _i - 1) div _n + 1").cast("int")
    return met.select(*df.columns, F.explode(F.sequence(F.lit(0), copies - 1)).alias("cycle"))


def contrast_groups(df: DataFrame, question: str, answer: str, scene: str) -> DataFrame:
    """Questions with several answers over several scenes."""
    g = df.groupBy(question).agg(F.countDistinct(answer).alias("answers"), F.countDistinct(scene).alias("scenes"), F.count("*").alias("rows"))
    return g.where("answers >= 2 and scenes >= 2")


def proportional_target(count: Column, target: int, total: Column) -> Column:
    """Share of a target, rounded half up, in whole numbers."""
    return F.floor((count * target + F.floor(total / 2)) / total).cast("long")


#: Fixed value: a label's or country's weight is this over its rows in the source, at least 1.
SCALE = 1_000_000_000
#: Groups that one round brings to the driver, and most labels and countries of all splits together.
ROUND = 256
MAX_GOALS = 10_000


def greedy_coverage(groups: DataFrame, target: int, floor: int, seed: str, labels: str = "labels", country: str = "country", size: str = "size", split: str = "split", group: str = "group_id", expected: tuple[str, ...] = ()) -> DataFrame:
    """(split, group, rank, gain, size): groups taken whole, each time the one that most lessens what is lacking, until
    ``target`` rows of a split are reached.

    ``labels`` is map<label, count>. A label lacks its share of the target (at least ``floor``), a country its own (at
    least 1). A group's gain is the sum, over its labels and its country, of the weight times the fall of the squared
    lack. Ties: the smaller seeded hash, then the id. Refused: a split of fewer rows than the target, one without an
    expected label, and labels that lack more than there is.

    A round computes all gains in Spark and brings the best ``ROUND`` groups of each split to the driver. As gains only
    fall, any group left behind is at most as good as the last one brought; so the driver goes on choosing among those
    it has until the best of them falls behind that one. Only these groups and the goals are ever on the driver.
    """
    from ..sources.shared import cut_lineage

    spark = groups.sparkSession
    key = [F.col(split).cast("string").alias("s"), F.col(group).cast("string").alias("g")]
    by_label = groups.select(*key, F.explode(labels).alias("name", "n")).select("s", "g", F.lit(True).alias("label"), "name", F.col("n").cast("long").alias("n")).where("n > 0")
    by_country = groups.select(*key, F.lit(False).alias("label"), F.col(country).alias("name"), F.col(size).cast("long").alias("n"))
    parts = cut_lineage(by_label.unionByName(by_country))
    goals = parts.groupBy("s", "label", "name").agg(F.sum("n").alias("n")).limit(MAX_GOALS + 1).collect()
    if len(goals) > MAX_GOALS:
        raise ValueError(f"more than {MAX_GOALS} labels and countries")
    rows: dict[str, int] = {}
    for r in goals:
        rows[r.s] = rows.get(r.s, 0) + (0 if r.label else r.n)
    lack, weight = {}, {}
    for r in goals:
        share = (r.n * target + rows[r.s] // 2) // rows[r.s]
        lack[r.s, r.label, r.name] = max(floor if r.label else 1, share)
        weight[r.s, r.label, r.name] = max(1, SCALE // r.n)
        if r.label and lack[r.s, r.label, r.name] > r.n:
            raise ValueError(f"split {r.s} has too few rows of {r.name}")
    for s, n in rows.items():
        if n < target:
            raise ValueError(f"split {s} has fewer rows than {target}")
        if gone := [x for x in expected if (s, True, x) not in lack]:
            raise ValueError(f"split {s} lacks the labels {gone}")

    def gain(s: str, own: list) -> int:
        return sum(weight[s, x.label, x.name] * (lack[s, x.label, x.name] ** 2 - max(0, lack[s, x.label, x.name] - x.n) ** 2) for x in own)

    taken: list[tuple] = []
    reached = dict.fromkeys(rows, 0)
    while open_splits := {s for s, n in reached.items() if n < target}:
        now = spark.createDataFrame([(*k, d, weight[k]) for k, d in lack.items() if k[0] in open_splits], "s string, label boolean, name string, d long, w long")
        used = spark.createDataFrame([(t[0], t[1]) for t in taken], "s string, g string")
        fall = F.col("w") * (F.col("d") * F.col("d") - F.pow(F.greatest(F.col("d") - F.col("n"), F.lit(0)), 2).cast("long"))
        scored = parts.join(F.broadcast(used), ["s", "g"], "left_anti").join(F.broadcast(now), ["s", "label", "name"])
        scored = scored.groupBy("s", "g").agg(F.sum(fall).alias("gain"), F.collect_list(F.struct("label", "name", "n")).alias("own"))
        ranked = scored.withColumn("h", F.sha2(F.concat(F.lit(seed + "\0"), "s", F.lit("\0"), "g"), 256))
        best = W.partitionBy("s").orderBy(F.col("gain").desc(), "h", "g")
        brought = ranked.withColumn("i", F.row_number().over(best)).where(F.col("i") <= ROUND).orderBy("s", "i").collect()
        for s in sorted(open_splits):
            left = [r for r in brought if r.s == s]
            last = (-left[-1].gain, left[-1].h, left[-1].g) if len(left) == ROUND else None
            while left and reached[s] < target:
                order = [(-gain(s, r.own), r.h, r.g) for r in left]
                first = min(order)
                if last is not None and first > last:
                    break
                r = left.pop(order.index(first))
                for x in r.own:
                    lack[s, x.label, x.name] = max(0, lack[s, x.label, x.name] - x.n)
                many = sum(x.n for x in r.own if not x.label)
                taken.append((s, r.g, sum(t[0] == s for t in taken), -first[0], many))
                reached[s] += many
    kinds = dict(groups.dtypes)
    out = spark.createDataFrame(taken, "s string, g string, rank int, gain long, n long")
    return out.select(F.col("s").cast(kinds[split]).alias(split), F.col("g").cast(kinds[group]).alias(group), "rank", "gain", F.col("n").alias(size))
