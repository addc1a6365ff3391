"""Reports of analyses as rows of their sections: what the record tells, evidence, edges, events and artifacts.

A report is not one value: the events of one analysis may be a third of all. Each row holds one line of one section
with the columns that order it (``ORDER``); ``written`` sorts by ranges of these, so a large report spans several tasks.
Sections of the record come from its payload (JSON) as VARIANT values; what is missing or of another kind has no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape

# The sections in their order, and the fields of an intent that a report tells.
SECTIONS = ("summary", "query", "intent", "inputs", "workflow", "answer", "evidence", "verification", "trace", "artifacts", "warnings", "rerun", "edges")
INTENT_FIELDS = ("task_family", "target_semantic", "requested_measurement", "temporal_direction", "spatial_request", "matched_rule", "ambiguities")
ORDER = ("analysis_id", "section_no", "at", "key", "n")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column, path: str) -> Column:
    """The text at a path; null where there is none or it is no text."""
    return F.when(_kind(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _strings(v: Column, path: str) -> Column:
    return F.transform(F.filter(_list(v, path), lambda x: _kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def _objects(v: Column, path: str) -> Column:
    return F.filter(_list(v, path), lambda x: F.startswith(_kind(x), F.lit("OBJECT")))


def _issues(v: Column, path: str) -> Column:
    """'code: message' of the issues that have a message."""
    told = F.filter(_objects(v, path), lambda x: F.coalesce(F.try_variant_get(x, "$.message", "string"), F.lit("")) != "")
    return F.transform(told, lambda x: F.concat(F.coalesce(F.try_variant_get(x, "$.code", "string"), F.lit("WARNING")), F.lit(": "), F.try_variant_get(x, "$.message", "string")))


def warnings(v: Column) -> Column:
    """Warnings of feasibility, reasons, and warnings of verification, each told once, where it came first."""
    reasons = F.filter(_strings(v, "$.reasons"), lambda x: x != "")
    return F.array_distinct(F.concat(_issues(v, "$.feasibility.warnings"), reasons, _issues(v, "$.verification.warnings")))


def passed(v: Column) -> Column:
    """Whether a verification answered and found no issue; null where there is none."""
    answered = F.coalesce(F.try_variant_get(v, "$.verification.answered", "boolean"), F.lit(False))
    return F.when(F.startswith(_kind(F.try_variant_get(v, "$.verification", "variant")), F.lit("OBJECT")), answered & (F.size(_objects(v, "$.verification.issues")) == 0))


def _line(section: str, key: Column | str, *cells: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), (F.lit(key) if isinstance(key, str) else key).alias("key"), F.array(*(c.cast("string") for c in cells)).alias("cells"))


def record_lines(v: Column) -> Column:
    """The lines of the sections that a payload (VARIANT) tells: array of struct(section, key, cells)."""
    one = lambda section, key, value: F.filter(F.array(_line(section, key, value)), lambda x: F.get(x["cells"], F.lit(0)).isNotNull())
    many = lambda section, key, values: F.transform(values, lambda x: _line(section, key, x))
    by_status = lambda status: F.transform(F.filter(_objects(v, "$.verification.evidence"), lambda x: F.try_variant_get(x, "$.status", "string") == status), lambda x: F.try_variant_get(x, "$.evidence_id", "string"))
    field = lambda k: F.coalesce(_string(v, f"$.intent.{k}"), F.to_json(F.try_variant_get(v, f"$.intent.{k}", "variant")))
    step = lambda s: _line("workflow", "step", *(F.coalesce(_string(s, f"$.{k}"), F.lit("")) for k in ("step_id", "tool_id")), F.array_join(_strings(s, "$.depends_on"), ","), F.coalesce(_string(s, "$.expected_evidence_type"), F.lit("")))
    return F.concat(
        F.array(_line("query", "query", F.coalesce(_string(v, "$.query"), F.lit("")))),
        one("query", "sha256", _string(v, "$.query_sha256")),
        *(one("intent", k, field(k)) for k in sorted(INTENT_FIELDS)),
        one("intent", "outcome", _string(v, "$.feasibility.outcome")),
        many("inputs", "observation", _strings(v, "$.observation_ids")),
        one("inputs", "pair", _string(v, "$.pair_id")),
        F.transform(_objects(v, "$.plan.steps"), step),
        one("workflow", "plan_hash", _string(v, "$.plan_hash")),
        one("workflow", "registry_hash", _string(v, "$.registry_hash")),
        one("answer", "outcome", _string(v, "$.answer.outcome")),
        one("answer", "text", _string(v, "$.answer.answer")),
        many("answer", "evidence", _strings(v, "$.answer.evidence_ids")),
        many("answer", "limitation", _strings(v, "$.answer.limitations")),
        one("verification", "passed", passed(v)),
        many("verification", "valid", by_status("valid")),
        many("verification", "invalid", by_status("invalid")),
        many("verification", "issue", _issues(v, "$.verification.issues")),
        many("warnings", "warning", warnings(v)),
        one("rerun", "rerun_of", _string(v, "$.rerun_of")),
    )


def _rows(df: DataFrame, section: str, at: str | None, key: Column, n: Column, *cells: str) -> DataFrame:
    when = F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")
    return df.select("analysis_id", F.lit(section).alias("section"), when.alias("at"), key.cast("string").alias("key"), n.cast("long").alias("n"), F.array(*(F.col(c).cast("string") for c in cells)).alias("cells"))


def report_rows(analyses: DataFrame, evidence: DataFrame, edges: DataFrame, artifacts: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    """(analysis_id, section_no, section, at, key, n, cells), unordered; only analyses of ``analyses`` have lines.

    analyses: analysis_id, status, created_at, updated_at, payload (JSON text); evidence: analysis_id, evidence_id,
    created_at, task (null: unknown); edges: analysis_id, source, target, edge_type, told once each; artifacts:
    analysis_id, artifact_id, evidence_id, media_type, sha256, size_bytes; jobs: job_id, analysis_id; events: job_id,
    sequence, event_type, created_at. An event follows its job to the analysis; the tables meet in no other join.
    """
    told = analyses.select("analysis_id", F.try_parse_json("payload").alias("v")).select("analysis_id", F.posexplode(record_lines(F.col("v"))).alias("n", "x"))
    record = told.select("analysis_id", "x.section", F.lit(None).cast("timestamp").alias("at"), F.lit("").alias("key"), F.col("n").cast("long").alias("n"), F.concat(F.array("x.key"), "x.cells").alias("cells"))
    none, first = F.lit(""), F.lit(0)
    more = (
        _rows(evidence.withColumn("task", F.coalesce(F.nullif("task", F.lit("")), F.lit("unknown"))), "evidence", "created_at", F.col("evidence_id"), first, "evidence_id", "task"),
        _rows(edges.select("analysis_id", "source", "target", "edge_type").distinct(), "edges", None, F.concat_ws("\0", "target", "source", "edge_type"), first, "target", "source", "edge_type"),
        _rows(artifacts, "artifacts", None, F.col("artifact_id"), first, "artifact_id", "evidence_id", "media_type", "sha256", "size_bytes"),
        _rows(events.join(jobs.select("job_id", "analysis_id"), "job_id"), "trace", "created_at", F.col("job_id"), F.col("sequence"), "job_id", "sequence", "event_type"),
    )
    rest = more[0].unionByName(more[1]).unionByName(more[2]).unionByName(more[3]).join(analyses.select("analysis_id"), "analysis_id", "left_semi")
    summary = _rows(analyses, "summary", None, none, first, "status", "created_at", "updated_at")
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int")
    return summary.unionByName(record).unionByName(rest).select("analysis_id", place.alias("section_no"), "section", "at", "key", "n", "cells")


def html(cells: Column) -> Column:
    """A line as a row of an HTML table; every value is escaped, a missing one is a dash."""
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), html_escape(F.coalesce(c, F.lit("-"))), F.lit("</td>"))), ""), F.lit("</tr>"))


def written(rows: DataFrame, path: str) -> None:
    """The lines of all reports as Parquet, in order across files and within them; fails where anything is there already."""
    ranged = rows.withColumn("html", html(F.col("cells"))).repartitionByRange(*ORDER)
    ranged.sortWithinPartitions(*ORDER).write.mode("errorifexists").parquet(path)
