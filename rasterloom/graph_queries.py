"""Registered queries of cycles, documents of any depth and drains, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import cycles as C
from .operators import documents as D
from .queries import query, read
from .sources.shared import shared_folder
from .streaming import drains as S
from .streaming.events import run_to_table


@query("SELECT o_orderkey AS node, count(*) OVER (PARTITION BY o_custkey // 8) AS size FROM orders WHERE o_custkey % 4 = 0")
def cycle_components(spark, sf_dir):
    """Each customer's orders in a chain; every fourth customer's chain ends where it begins, and two such rings are tied to
    each other. Lines hang behind the orders; edges of a type that does not count would close all other chains too."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    all_ = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.lead("o_orderkey").over(w).alias("next"), F.min("o_orderkey").over(all_).alias("first"), F.max("o_orderkey").over(all_).alias("last"))
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("edge_type"))
    ring = F.col("o_custkey") % 4 == 0
    ends = o.where((F.col("k") == F.col("first")) & ring).select("o_custkey", "first")
    tied = ends.where("o_custkey % 8 = 0").join(ends.select((F.col("o_custkey") - 4).alias("o_custkey"), F.col("first").alias("other")), "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (-F.col("l_orderkey") * 10 - F.col("l_linenumber")).alias("line"))
    close = o.where(F.col("k") == F.col("last"))
    edges = edge(o.where("next is not null"), "k", "next", "DERIVED_FROM").union(edge(close.where(ring), "k", "first", "DERIVED_FROM")).union(edge(close.where(~ring), "k", "first", "SUPPORTS"))
    edges = edges.union(edge(tied, "first", "other", "DERIVED_FROM")).union(edge(tied, "other", "first", "MEASURED_FROM")).union(edge(lines, "l_orderkey", "line", "MEASURED_FROM"))
    found = C.cycles(edges, C.DERIVATION)
    return found.select("node", F.count("*").over(W.partitionBy("component")).alias("size"))


def _documents(spark, sf_dir):
    """A document an order: nested objects and arrays, keys in several cases, local paths and addresses at several depths."""
    k = F.col("o_orderkey")
    point = F.array(k.cast("double"), F.lit(1.5))
    place = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: point)).alias("coordinates"))
    note = F.when(k % 7 == 1, F.lit("HTTPS://x.y")).when(k % 7 == 2, F.lit("/etc")).when(k % 7 == 3, F.lit("see http://x")).otherwise(F.lit("plain"))
    deep = F.struct(F.array(F.struct(F.lit("p").alias("path"), k.alias("k"), F.struct(F.lit(None).cast("string").alias("path"), F.array(F.lit("a\"b"), F.lit("é\n")).alias("list")).alias("inner"))).alias("items"))
    plain = F.struct(F.array(F.struct(k.alias("k"), F.struct(F.array(F.lit("a\"b"), F.lit("é\n")).alias("list")).alias("inner"))).alias("items"))
    body = lambda d: F.to_json(F.struct(F.lit("/not a path/").alias("query"), place.alias("geometry"), F.array(note).alias("notes"), d.alias("deep"), F.array().cast("array<int>").alias("none")), {"ignoreNullFields": "false"})
    named = F.when(k % 7 == 4, F.concat(F.lit('{"Model": 1, "geometry": [[1, 2], [true, 2], [3]], "other": {"coordinates": [5, 6]}}'))).when(k % 7 == 5, F.lit("[]")).when(k % 7 == 6, F.lit("{broken"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(named, body(plain)).alias("doc"), F.coalesce(named, body(deep)).alias("full"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN o_orderkey % 7 IN (1, 2, 4) END AS unsafe, CASE o_orderkey % 7 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 6 THEN NULL ELSE o_orderkey % 4 + 1 END AS vertices FROM orders"""
)
def unsafe_inputs(spark, sf_dir):
    return D.input_checks(_documents(spark, sf_dir), "o_orderkey", "doc").select("o_orderkey", "unsafe", "vertices")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 4 OR o_orderkey % 7 = 0 THEN '{"deep":{"items":[{"inner":{"list":["a\\"b","é\\n"]},"k":' || o_orderkey || '}]},"geometry":{"coordinates":[[' || array_to_string(list_transform(range(o_orderkey % 4 + 1), lambda i: '[' || printf('%d', o_orderkey) || ',1.5]'), ',') || ']],"type":"Polygon"},"none":[],"notes":["' || CASE o_orderkey % 7 WHEN 1 THEN 'HTTPS://x.y' WHEN 2 THEN '/etc' WHEN 3 THEN 'see http://x' ELSE 'plain' END || '"],"query":"/not a path/"}'
      WHEN o_orderkey % 7 = 4 THEN '{"Model":1,"geometry":[[1,2],[true,2],[3]],"other":{"coordinates":[5,6]}}' WHEN o_orderkey % 7 = 5 THEN '[]' END AS doc FROM orders"""
)
def stripped_paths(spark, sf_dir):
    """Documents without any field 'path', whatever its depth; keys come in alphabetical order, whole numbers without a point."""
    d = D.stripped(_documents(spark, sf_dir), "o_orderkey", "full", "path")
    return d.select("o_orderkey", F.regexp_replace("full", r"(\d)\.0(?=[,\]])", "$1").alias("doc"))


# Six events are a job, 0.7 seconds apart; some are changes of its status.
_JOBS = """j AS (SELECT event_id // 6 AS job_id, event_id % 6 AS sequence, make_timestamp(1704067200000000 + event_id * 700000) AS ts, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'signup' THEN 'INTERRUPTED' END AS status, event_type = 'purchase' AS terminal FROM events)"""


@query(
    f"""WITH {_JOBS}, m AS (SELECT max(ts) AS newest FROM j), f AS (SELECT job_id, arg_min(status, ts) AS status, min(ts) AS t FROM j WHERE status IS NOT NULL GROUP BY job_id),
    e AS (SELECT f.*, (SELECT min(greatest(j.ts, t)) FROM j WHERE j.job_id = f.job_id AND j.terminal AND j.ts <= t + INTERVAL 2 SECOND) AS seen FROM f),
    c AS (SELECT job_id, CASE WHEN status = 'INTERRUPTED' THEN t ELSE coalesce(seen, t + INTERVAL 2 SECOND) END AS closed_at, CASE WHEN status = 'INTERRUPTED' THEN status WHEN seen IS NOT NULL THEN 'EVENT' ELSE 'DRAIN' END AS reason FROM e)
    SELECT c.job_id, epoch_us(closed_at) AS closed_at, reason, coalesce((SELECT max(sequence) FROM j WHERE j.job_id = c.job_id AND j.status IS NULL AND j.ts <= closed_at), -1) AS last FROM c, m WHERE reason <> 'DRAIN' OR closed_at < newest"""
)
def terminal_drain(spark, sf_dir):
    """The events as a stream: where each job's ends, by its status, its terminal event, or a timer two seconds after the status."""
    schema = read(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "INTERRUPTED")
    rows = e.select(F.expr("event_id div 6").alias("job_id"), F.expr("timestamp_micros(1704067200000000 + event_id * 700000)").alias("ts"), (F.col("event_id") % 6).alias("sequence"), status.alias("status"), F.when(F.col("event_type") == "purchase", "job_succeeded").otherwise(F.col("event_type")).alias("event_type"))
    folder = f"{shared_folder(spark)}/drain_{uuid.uuid4().hex}"
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, S.STATE_STORE)
    try:
        found = run_to_table(S.drains(rows), f"{folder}/rows", f"{folder}/checkpoint")
    finally:
        spark.conf.set(name, before)
    return found.select("job_id", F.unix_micros("closed_at").alias("closed_at"), "reason", "last")
