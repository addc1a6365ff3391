"""Evidence tables: edges, verification, cycles, stores with first-writer and page semantics, state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import is_close
from ..functions.text import cursor
from ..sources.shared import cut_lineage
from .ranks import numbered

# Which state may follow which.
JOB_TRANSITIONS = {
    "QUEUED": ("RUNNING", "FAILED", "CANCELLED"),
    "RUNNING": ("SUCCEEDED", "FAILED", "CANCEL_REQUESTED", "INTERRUPTED"),
    "CANCEL_REQUESTED": ("CANCELLED", "FAILED", "INTERRUPTED"),
}
ANALYSIS_TRANSITIONS = {
    "PENDING": ("RUNNING", "FAILED", "ABSTAINED", "REJECTED", "CANCELLED"),
    "RUNNING": ("SUCCEEDED", "FAILED", "ABSTAINED", "CANCELLED", "INTERRUPTED"),
}


def derive_edges(nodes: DataFrame) -> DataFrame:
    """Distinct (source, target, edge_type) from nodes (evidence_id, task, source_evidence_id, first_evidence_id,
    second_evidence_id, parents array<string>)."""
    own = F.col("evidence_id").alias("target")
    measured = nodes.where("task = 'measurement'").select(F.col("source_evidence_id").alias("source"), own, F.lit("MEASURED_FROM").alias("edge_type"))
    compared = nodes.where("task = 'mask_agreement'").select(F.explode(F.array("first_evidence_id", "second_evidence_id")).alias("source"), own, F.lit("DERIVED_FROM").alias("edge_type"))
    parents = nodes.where("task <> 'measurement'").select(F.explode("parents").alias("source"), own, F.lit("DERIVED_FROM").alias("edge_type")).where("source <> target")
    parents = parents.join(nodes.select(F.col("evidence_id").alias("source")), "source", "left_semi")
    return measured.unionByName(compared).unionByName(parents).distinct()


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that no node has."""
    ids = nodes.select("evidence_id")
    lost = lambda side: edges.join(ids, edges[side] == ids["evidence_id"], "left_anti")
    return lost("source").unionByName(lost("target")).distinct()


def conflicting(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys that carry more than one payload."""
    return df.groupBy(key).agg(F.countDistinct(payload).alias("payloads")).where("payloads > 1")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on or downstream of a cycle: what is left after taking away, round by round, nodes that nothing precedes.

    Rounds are as many as the longest chain (plans of some steps); each is one anti-join, checkpointed.
    """
    left = cut_lineage(edges.select("source", "target").distinct())
    n = left.count()
    while n:
        kept = cut_lineage(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi"))
        if (m := kept.count()) == n:
            break
        left, n = kept, m
    return left.select(F.col("target").alias("node")).distinct()


def verify_measurements(nodes: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(evidence_id, outcome): each measurement against its source and a recomputed value (evidence_id, value)."""
    source = nodes.select(F.col("evidence_id").alias("_sid"), F.col("task").alias("_stask"))
    again = recomputed.select("evidence_id", F.col("value").alias("_again"))
    met = nodes.where("task = 'measurement'").join(source, F.col("source_evidence_id") == F.col("_sid"), "left").join(again, "evidence_id", "left")
    outcome = (
        F.when(F.col("_sid").isNull(), "MISSING_SOURCE")
        .when(~F.col("_stask").isin("change_localize", "flood_segmentation"), "WRONG_SOURCE_TYPE")
        .when(F.col("_again").isNull(), "NOT_RECOMPUTED")
        .when(~is_close(F.col("value"), F.col("_again"), 1e-9, 1e-9), "VALUE_MISMATCH")
        .otherwise("VALID")
    )
    return met.select("evidence_id", outcome.alias("outcome"))


def report(analyses: DataFrame, evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``analyses`` (analysis_id, ...) with ``evidence``: its evidence, newest first, each with its sorted artifacts.

    Artifacts are grouped onto evidence before that onto analyses, so a row is as large as one analysis.
    """
    own = artifacts.groupBy("evidence_id").agg(F.sort_array(F.collect_list("artifact_id")).alias("artifacts"))
    empty = F.array().cast(own.schema["artifacts"].dataType)
    met = evidence.join(own, "evidence_id", "left").withColumn("artifacts", F.coalesce("artifacts", empty))
    nested = met.groupBy("analysis_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "evidence_id", "task", "artifacts")), asc=False).alias("evidence"))
    none = F.array().cast(nested.schema["evidence"].dataType)
    return analyses.join(nested, "analysis_id", "left").withColumn("evidence", F.coalesce("evidence", none))


#: The fields of a node that name other evidence, besides its parents.
REFERENCES = ("source_evidence_id", "first_evidence_id", "second_evidence_id")


def remapped(nodes: DataFrame, replayed: DataFrame) -> DataFrame:
    """Nodes of cached payloads under new ids: ``nodes`` with evidence_id, parents and the fields ``REFERENCES`` renamed, and ``miss``.

    nodes: payload, evidence_id, new_id, parents (an array) and ``REFERENCES``; replayed: (old, new), the ids that were
    renamed before. A reference is looked up among the payload's own nodes first, then among the replayed ones. One that
    is found in neither makes the whole payload a miss: its step must run again, so all references of its nodes are null.
    """
    ref = lambda slot, i, c: F.struct(F.lit(slot).alias("slot"), i.alias("i"), c.alias("old"))
    fields = F.filter(F.array(*(ref(c, F.lit(0), F.col(c)) for c in REFERENCES)), lambda r: r["old"].isNotNull())
    parents = F.transform(F.coalesce("parents", F.array().cast("array<string>")), lambda p, i: ref("parents", i, p))
    asked = nodes.select("payload", "evidence_id", F.explode(F.concat(fields, parents)).alias("r")).select("payload", "evidence_id", "r.*")
    own = nodes.select("payload", F.col("evidence_id").alias("old"), F.col("new_id").alias("_own")).distinct()
    told = asked.join(own, ["payload", "old"], "left").join(replayed.select("old", F.col("new").alias("_new")), "old", "left").withColumn("new", F.coalesce("_own", "_new"))
    missed = told.where("new is null").select("payload").distinct().withColumn("_miss", F.lit(True))
    each = told.groupBy("payload", "evidence_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("slot") == "parents", F.struct("i", "new")))).alias("_p"), *(F.max(F.when(F.col("slot") == c, F.col("new"))).alias(f"_{c}") for c in REFERENCES)
    )
    met = nodes.join(each, ["payload", "evidence_id"], "left").join(missed, "payload", "left")
    whole = F.col("_miss").isNull()
    names = F.coalesce(F.transform("_p", lambda p: p["new"]), F.array().cast("array<string>"))
    renamed = {"evidence_id": F.col("new_id"), "parents": F.when(whole, names), **{c: F.when(whole, F.col(f"_{c}")) for c in REFERENCES}}
    return met.select(*(renamed.get(c, F.col(c)).alias(c) for c in nodes.columns if c != "new_id"), (~whole).alias("miss"))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: of each new key that does not exist yet, the first."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return first.join(existing.select(key), key, "left_anti")


def page(df: DataFrame, time: str, key: str, size: int, before: tuple | None = None) -> DataFrame:
    """Newest first, ``size`` rows; ``before`` is the last (time, key) of the page before."""
    if not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    if before is not None:
        t, k = map(F.lit, before)
        df = df.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k)))
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(size)


def next_cursor(rows: DataFrame, time: str, key: str, size: int) -> DataFrame:
    """One row, ``cursor``: where the page after ``rows`` (a page of at most 100) begins; null where the page is not full."""
    last = F.min_by(F.struct(F.col(time).alias("t"), F.col(key).alias("k")), F.struct(F.col(time), F.col(key)))
    found = rows.agg(F.count("*").alias("n"), last.alias("x"))
    return found.select(F.when(F.col("n") == size, cursor(F.col("x.t"), F.col("x.k"))).alias("cursor"))


def cached(keys: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """``keys`` (cache_key) with hit and payload (text): what a store of results (cache_key, payload: JSON) holds for them.

    files: (artifact_id, sha256), hashed again when they are read. Any doubt is a miss: a key that is no digest, a
    payload that is no object, an artifact without a name or a hash, or one whose file is not there or has another hash.
    """
    held = keys.join(entries.select("cache_key", "payload"), "cache_key", "left")
    parsed = held.withColumn("_v", F.try_parse_json("payload"))
    listed = F.try_variant_get("_v", "$.artifacts", "array<variant>")
    parsed = parsed.withColumn("_a", F.transform(listed, lambda a: F.struct(F.try_variant_get(a, "$.artifact_id", "string").alias("id"), F.try_variant_get(a, "$.sha256", "string").alias("sha"))))
    # An entry that is there but no list counts as doubtful too.
    odd = F.col("_a").isNull() & F.try_variant_get("_v", "$.artifacts", "variant").isNotNull() & ~F.coalesce(F.is_variant_null(F.try_variant_get("_v", "$.artifacts", "variant")), F.lit(True))
    fine = F.col("cache_key").rlike(r"\A[0-9a-f]{64}\z") & F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)) & ~odd
    parsed = parsed.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    asked = parsed.where("_fine").select("cache_key", F.explode("_a").alias("a")).select("cache_key", F.col("a.id").alias("artifact_id"), F.col("a.sha").alias("sha256"))
    broken = asked.join(files.select("artifact_id", "sha256").distinct().withColumn("_there", F.lit(True)), ["artifact_id", "sha256"], "left").where("_there is null").select("cache_key").distinct().withColumn("_broken", F.lit(True))
    met = parsed.join(broken, "cache_key", "left").withColumn("hit", F.col("_fine") & F.col("_broken").isNull())
    return met.select(*keys.columns, "hit", F.when(F.col("hit"), F.col("payload")).alias("payload"))


def sequence_gaps(events: DataFrame, key: str, sequence: str) -> DataFrame:
    """Events whose sequence does not follow the one before it (the first must be 0)."""
    last = F.lag(sequence).over(W.partitionBy(key).orderBy(sequence))
    return events.withColumn("expected", F.coalesce(last + 1, F.lit(0))).where(F.col(sequence) != F.col("expected"))


def illegal_transitions(events: DataFrame, key: str, order: str, state: str, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """Events whose state may not follow the state before it."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(order))
    allowed = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    legal = F.array_contains(F.coalesce(F.try_element_at(allowed, F.col("before")), F.array().cast("array<string>")), F.col(state))
    return events.withColumn("before", before).where(F.col("before").isNotNull() & ~legal)


def latest(events: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """The values of each key's last event."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_x")).select(key, "_x.*")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with the side that has it: none means equal sets."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def copy_as(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """The rows of one key under another one, to append."""
    return df.where(F.col(key) == old).withColumn(key, F.lit(new))


def submissions(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (key_hash, request_hash) with an outcome: REPLAY, CONFLICT (another body under the key) or NEW."""
    known = existing.select("key_hash", F.col("request_hash").alias("_known"))
    outcome = F.when(F.col("_known").isNull(), "NEW").when(F.col("_known") == F.col("request_hash"), "REPLAY").otherwise("CONFLICT")
    return requests.join(known, "key_hash", "left").withColumn("outcome", outcome).drop("_known")


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what ran is interrupted."""
    return jobs.withColumn("status", F.when(F.col("status") == "RUNNING", "INTERRUPTED").otherwise(F.col("status")))


def derangement(keys: DataFrame, key: str, shift: int = 1) -> DataFrame:
    """(key, other): each key with the one ``shift`` places after it, round the end; no key meets itself if there are two
    and the shift is no multiple of their number. Places are counted in ranges of the keys, in several tasks."""
    placed = cut_lineage(numbered(keys.select(key).distinct(), [F.col(key)], "_i"))
    n = placed.count()
    other = placed.select(F.col(key).alias("other"), F.col("_i").alias("_j"))
    return placed.withColumn("_j", (F.col("_i") + shift) % F.lit(max(n, 1))).join(other, "_j").select(key, "other")


def transition(rows: DataFrame, key: str, expected: str, new: str, moved: DataFrame, table: dict[str, tuple[str, ...]], at: Column) -> DataFrame:
    """``rows`` with the keys of ``moved`` in state ``new``, where they were in ``expected`` and the move is legal.

    ``won`` tells which rows moved; a key in another state stays as it is. ``updated_at`` never goes back.
    """
    if new not in table.get(expected, ()):
        raise ValueError(f"{expected} may not become {new}")
    asked = moved.select(key).distinct().withColumn("_asked", F.lit(True))
    won = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("status") == expected)
    met = rows.join(asked, key, "left").withColumn("won", won)
    return met.withColumns({"status": F.when(F.col("won"), new).otherwise(F.col("status")), "updated_at": F.when(F.col("won"), F.greatest("updated_at", at)).otherwise(F.col("updated_at"))}).drop("_asked")
