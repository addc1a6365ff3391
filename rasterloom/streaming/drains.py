"""When the stream of a job's events ends: at its terminal event, some time after its terminal status, or at once."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import TERMINAL

#: Fixed value: how many seconds a terminal status waits for the terminal event.
DRAIN = 2.0
#: Fixed value of a stream's checkpoint: groups of jobs.
GROUPS = 1 << 16
INTERRUPTED = "INTERRUPTED"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RESULT = "job_id {0}, closed_at timestamp, reason string, last long"


def _update(wait: int):
    """State of a group, pickled: by job the deadline of its drain (microseconds; -1: none), whether a terminal event was seen, the last sequence, whether it is closed."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        jobs, told = pickle.loads(state.get[0]) if state.exists else {}, []

        def close(job, at: int, reason: str) -> None:
            jobs[job] = (*jobs[job][:3], True)
            told.append((job, at, reason, jobs[job][2]))

        rows = [x for b in batches for x in zip(*(b[c].tolist() for c in ("at", "sequence", "status", "terminal", "job_id")))]
        for at, sequence, status, terminal, job in sorted(rows, key=lambda x: x[:2]):
            due, seen, last, closed = jobs.setdefault(job, (-1, False, -1, False))
            if closed:
                continue
            if 0 <= due < at:
                close(job, due, "DRAIN")
            elif status is None or status != status:
                jobs[job] = (due, seen or bool(terminal), max(last, sequence), False)
                if due >= 0 and terminal:
                    close(job, at, "EVENT")
            elif due < 0 and status == INTERRUPTED:
                close(job, at, INTERRUPTED)
            elif due < 0 and status in TERMINAL:
                jobs[job] = (at + wait, seen, last, False)
                if seen:
                    close(job, at, "EVENT")
        now, waiting = state.getCurrentWatermarkMs(), []
        for job, (due, _, _, closed) in list(jobs.items()):
            if due >= 0 and not closed:
                # Whole milliseconds: the watermark has no others.
                if due // 1000 < now:
                    close(job, due, "DRAIN")
                else:
                    waiting.append(due // 1000)
        state.update((pickle.dumps(jobs),))
        if waiting:
            # Each call sets its timer anew; it fires once the watermark is beyond it.
            state.setTimeoutTimestamp(max(min(waiting), now + 1))
        if told:
            job, at, reason, last = zip(*told)
            yield pd.DataFrame({"job_id": job, "closed_at": np.array(at, "datetime64[us]"), "reason": reason, "last": last})

    return update


def drains(rows: DataFrame, late: str = "0 seconds", wait: float = DRAIN, groups: int = GROUPS) -> DataFrame:
    """(job_id, closed_at, reason, last): where each job's stream of events ends, and the last sequence told until then.

    rows: a stream of job_id, ts, sequence and event_type of events, and of rows with a ``status``. INTERRUPTED ends a job
    at once. Another terminal status ends it if its terminal event has been seen, else at that event, else ``wait`` seconds later:
    a timer in event time, kept in the state of the job, fires once the watermark (``late`` behind the newest row) has
    passed it, so jobs are closed without a row of their own. What comes after is not told. State is four values a job, kept by
    ``groups`` groups of jobs, so that a call's cost is shared by the jobs of a group; a batch rewrites the groups it meets.
    """
    terminal = F.col("status").isNull() & F.col("event_type").isin(*(f"job_{s.lower()}" for s in TERMINAL))
    keyed = rows.withWatermark("ts", late).select("job_id", "ts", F.coalesce("sequence", F.lit(-1)).cast("long").alias("sequence"), "status", F.coalesce(terminal, F.lit(False)).alias("terminal"), F.unix_micros("ts").alias("at"))
    kind = rows.schema["job_id"].dataType.simpleString()
    grouped = keyed.withColumn("group", F.pmod(F.xxhash64("job_id"), F.lit(groups))).groupBy("group")
    return grouped.applyInPandasWithState(_update(int(wait * 1_000_000)), _RESULT.format(kind), "jobs binary", "append", "EventTimeTimeout")
