"""Cooperative cancellation of jobs: who may still be cancelled, and which outputs of their steps are published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cancel_requests(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (job_id, at) by job: job_id, at (of the first), n_requests, outcome, event.

    A queued job is CANCELLED at once, a running one CANCEL_REQUESTED; another state is a CONFLICT, a job that is not
    in ``jobs`` (job_id, status) is UNKNOWN. Of several requests the first counts; the others meet a state that is no
    longer queued or running. Requests are counted before the join, so a job that is asked often is one row there."""
    first = requests.groupBy("job_id").agg(F.min("at").alias("at"), F.count("*").alias("n_requests"))
    status = F.col("status")
    outcome = F.when(status.isNull(), "UNKNOWN").when(status == "QUEUED", "CANCELLED").when(status == "RUNNING", "CANCEL_REQUESTED").otherwise("CONFLICT")
    met = first.join(jobs.select("job_id", "status"), "job_id", "left").withColumn("outcome", outcome)
    return met.select("job_id", "at", "n_requests", "outcome", F.when(F.col("outcome").isin("CANCELLED", "CANCEL_REQUESTED"), F.col("outcome")).alias("event"))


def step_outcomes(steps: DataFrame, cancels: DataFrame) -> DataFrame:
    """``steps`` (job_id, started, ended, ...) with an outcome, by ``cancels`` (job_id, at; one a job).

    A job looks for its cancellation before each step and after it: a step that had not begun is SKIPPED, the outputs
    of one that ended at that time or later, or never, are DISCARDED, those that ended before are PUBLISHED. A step
    without an end and a cancellation is RUNNING, one without a begin PENDING."""
    at, started, ended = F.col("_at"), F.col("started"), F.col("ended")
    outcome = (
        F.when(at.isNull(), F.when(started.isNull(), "PENDING").when(ended.isNull(), "RUNNING").otherwise("PUBLISHED"))
        .when(started.isNull() | (at <= started), "SKIPPED")
        .when(ended.isNull() | (at <= ended), "DISCARDED")
        .otherwise("PUBLISHED")
    )
    return steps.join(cancels.select("job_id", F.col("at").alias("_at")), "job_id", "left").withColumn("outcome", outcome).drop("_at")
