"""Cycles, documents, drains, and stores of results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import cycles as C
from rasterloom.operators import documents as D


def reachable(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    out = {}
    for a in to:
        seen, left = set(), list(to[a])
        while left:
            if (b := left.pop()) not in seen:
                seen.add(b)
                left += to.get(b, ())
        out[a] = seen
    return out


def test_cycles_equal_reachability(spark):
    rng = random.Random(1)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(75)]
    base = n
    for size in (1, 2, 5, 9):  # rings, chains behind and before them, and repeated edges
        ring = [(base + i, base + (i + 1) % size) for i in range(size)]
        tail = [(base, base + 50)] + [(base + 50 + i, base + 51 + i) for i in range(7)] + [(base + 70 + i, base + 71 + i) for i in range(5)] + [(base + 75, base)]
        edges += ring + tail + ring
        base += 100
    got = {r.node: r.component for r in C.cycles(spark.createDataFrame(edges + [(None, 1), (2, None)], "source int, target int")).collect()}
    way = reachable(edges)
    on = {a for a in way if a in way[a]}
    assert set(got) == on
    for a in on:
        assert {b for b in on if got[b] == got[a]} == {b for b in on if b == a or (b in way[a] and a in way[b])}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    cut = C.Scratch.__call__
    monkeypatch.setattr(C.Scratch, "__call__", lambda self, df: rounds.append(1) or cut(self, df))
    chain = spark.range(10_000).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit("DERIVED_FROM").alias("edge_type"))
    loop = spark.createDataFrame([(10_001, 10_002, "DERIVED_FROM"), (10_002, 10_001, "MEASURED_FROM"), (10_000, 10_001, "DERIVED_FROM"), (10_000, 0, "SUPPORTS")], "source long, target long, edge_type string")
    assert {r.node for r in C.cycles(chain.union(loop), C.DERIVATION).collect()} == {10_001, 10_002}
    assert len(rounds) < 80


def strip(v, names):
    return {k: strip(x, names) for k, x in v.items() if k not in names} if isinstance(v, dict) else [strip(x, names) for x in v] if isinstance(v, list) else v


def test_documents(spark):
    docs = ['{"a": {"path": 1, "Path": [{"path": {"b": 1}}, 2.5, null, true, "x"]}, "é\\"k": [], "o": {}}', "[]", "{", None, '"text"', '{"path": "/x"}', '[[[[{"path": [1], "c": [[1, 2], {"path": 0}]}]]]]', '{"geometry": {"coordinates": [[[1, 2], [3, 4, 5]], [[1, "2"], [6]]], "extra": [7, 8]}}', '{"query": "/x", "z": ["file:///y"]}', '{"URL": 1}', '{"k": "httpx://"}', "[1, 2]", "[true, 2]"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = {r.id: r.doc for r in D.stripped(df, "id", "doc", "path").collect()}
    for i, d in enumerate(docs):
        if d in ("{", None):
            assert got[i] is None
        else:
            assert json.loads(got[i]) == strip(json.loads(d), {"path"})
    checks = {r.id: (r.unsafe, r.vertices) for r in D.input_checks(df, "id", "doc").collect()}
    assert checks == {0: (True, 0), 1: (False, 0), 2: (None, None), 3: (None, None), 4: (False, 0), 5: (True, 0), 6: (True, 0), 7: (False, 2), 8: (True, 0), 9: (True, 0), 10: (False, 0), 11: (False, 1), 12: (False, 0)}
    deep = spark.createDataFrame([(1, "[" * 70 + "]" * 70)], "id int, doc string")
    with pytest.raises(ValueError):
        D.stripped(deep, "id", "doc", "path")


def test_drains_over_several_batches(spark, tmp_path):
    """Files one by one: an event that closes, a timer that fires without a row of its job, an end that comes before all else."""
    from rasterloom.streaming import drains as S
    from rasterloom.streaming import events as V

    row = lambda job, t, sequence=None, status=None, kind=None: (job, t, sequence, status, kind)
    batches = [
        [row("event", 10, 0, None, "step"), row("event", 11, None, "SUCCEEDED"), row("timer", 10, 4, None, "step"), row("timer", 11, None, "FAILED"), row("at once", 10, 1, None, "step"), row("seen", 9, 7, None, "job_failed")],
        [row("event", 12, 1, None, "job_succeeded"), row("event", 12, 2, None, "late"), row("at once", 12, None, "INTERRUPTED"), row("seen", 12, None, "FAILED"), row("open", 12, None, "RUNNING")],
        [row("open", 100, 0, None, "step"), row("at once", 101, 5, None, "job_failed"), row("timer", 101, 9, None, "job_failed")],
        [row("open", 200, 1, None, "step"), row("same", 200, 3, None, "job_failed"), row("same", 198, None, "FAILED"), row("after", 203, 3, None, "job_failed"), row("after", 200, None, "FAILED")],
    ]
    schema = "job_id string, t long, sequence long, status string, event_type string"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    kind = spark.read.parquet(str(tmp_path / "in" / "b0")).schema
    import os
    import time

    for i in range(len(batches)):  # the order of files is that of their times
        for f in (tmp_path / "in" / f"b{i}").iterdir():
            os.utime(f, (time.time() - 100 + i, time.time() - 100 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {r.job_id: (int(r.closed_at.timestamp()), r.reason, r.last) for r in V.run_to_table(S.drains(stream), str(tmp_path / "out"), str(tmp_path / "c")).collect()}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {"event": (12, "EVENT", 1), "timer": (13, "DRAIN", 4), "at once": (12, "INTERRUPTED", 1), "seen": (12, "EVENT", 7), "same": (200, "EVENT", 3), "after": (202, "DRAIN", -1)}
