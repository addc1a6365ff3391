"""Registered queries of reports, cancellation, map tiles, planned workflows and strict records, with their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from .functions import text as X
from .operators import jobs as JB
from .operators import raster as R
from .operators import reports as RP
from .operators import tiles as TL
from .plans import feasibility as FS
from .plans import workflow as WF
from .queries import query, read, tile_pairs
from .raster_queries import _SQL_RASTERS, _grid, _rasters
from .sources import tables as ST
from .sources.shared import shared_folder

# Payloads of customers: every fifth is no JSON; steps, ids and issues hold values of wrong kinds, which have no line.
_PAYLOAD = (
    '{"query":"area <%1$d>","intent":{"task_family":"CHANGE_MEASURE","ambiguities":[%1$d],"hidden":1},"observation_ids":["o%1$d",7,"p%1$d"],'
    '"plan":{"steps":[{"step_id":"a","tool_id":"t","depends_on":[]},{"step_id":"b","tool_id":"u","depends_on":["a",1],"expected_evidence_type":"mask"},3]},"plan_hash":"h%1$d",'
    '"answer":{"outcome":"ALLOW","answer":"x & %1$d","evidence_ids":["o%1$d"],"limitations":"none"},"feasibility":{"outcome":"OK","warnings":[{"message":"late"},{"code":"W","message":"late"},{"code":"V"}]},"reasons":["r",""],'
    '"verification":{"answered":true,"issues":[%2$s],"warnings":[{"code":"W","message":"late"},{"code":"Z","message":"q"}],"evidence":[{"status":"valid","evidence_id":"e%1$d"},{"status":"invalid","evidence_id":"f%1$d"}]}%3$s}'
)


def _td(*cells: str) -> str:
    return "'<tr>' || " + " || ".join(f"'<td>' || {c} || '</td>'" for c in cells) + " || '</tr>'"


_LINES = (
    ("query", "true", "'query'", "CASE WHEN k % 5 = 0 THEN '' ELSE 'area &lt;' || k || '&gt;' END"),
    ("intent", "k % 5 <> 0", "'task_family'", "'CHANGE_MEASURE'"),
    ("intent", "k % 5 <> 0", "'ambiguities'", "'[' || k || ']'"),
    ("intent", "k % 5 <> 0", "'outcome'", "'OK'"),
    ("inputs", "k % 5 <> 0", "'observation'", "'o' || k"),
    ("inputs", "k % 5 <> 0", "'observation'", "'p' || k"),
    ("workflow", "k % 5 <> 0", "'step'", "'a'", "'t'", "''", "''"),
    ("workflow", "k % 5 <> 0", "'step'", "'b'", "'u'", "'a'", "'mask'"),
    ("workflow", "k % 5 <> 0", "'plan_hash'", "'h' || k"),
    ("answer", "k % 5 <> 0", "'outcome'", "'ALLOW'"),
    ("answer", "k % 5 <> 0", "'text'", "'x &amp; ' || k"),
    ("answer", "k % 5 <> 0", "'evidence'", "'o' || k"),
    ("verification", "k % 5 <> 0", "'passed'", "CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END"),
    ("verification", "k % 5 <> 0", "'valid'", "'e' || k"),
    ("verification", "k % 5 <> 0", "'invalid'", "'f' || k"),
    ("verification", "k % 5 <> 0 AND k % 2 = 1", "'issue'", "'C: m'"),
    *(("warnings", "k % 5 <> 0", "'warning'", w) for w in ("'WARNING: late'", "'W: late'", "'r'", "'Z: q'")),
    ("rerun", "k % 5 <> 0 AND k % 3 = 0", "'rerun_of'", "'a' || k"),
)
_SQL_REPORT = " UNION ALL ".join(
    [f"SELECT k AS analysis_id, '{s}' AS section, {_td(*cells)} AS html FROM c WHERE {where}" for s, where, *cells in _LINES]
    + [
        f"SELECT k, 'summary', {_td('m', chr(39) + '1995-01-01 00:00:00' + chr(39), chr(39) + '1995-01-02 00:00:00' + chr(39))} FROM c",
        f"SELECT o_custkey, 'evidence', {_td(chr(39) + 'o' + chr(39) + ' || o_orderkey', 'CASE o_orderstatus WHEN ' + chr(39) + 'F' + chr(39) + ' THEN ' + chr(39) + 'unknown' + chr(39) + ' ELSE o_orderstatus END')} FROM orders JOIN c ON k = o_custkey",
        f"SELECT DISTINCT o_custkey, 'edges', {_td(chr(39) + 'o' + chr(39) + ' || o_orderkey', chr(39) + 'p' + chr(39) + ' || l_partkey', chr(39) + 'DERIVED_FROM' + chr(39))} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c ON k = o_custkey",
        f"SELECT o_custkey, 'artifacts', {_td(chr(39) + 'l' + chr(39) + ' || l_orderkey || ' + chr(39) + '_' + chr(39) + ' || l_linenumber', chr(39) + 'o' + chr(39) + ' || l_orderkey', chr(39) + 'image/tiff' + chr(39), 'sha256(CAST(l_orderkey AS VARCHAR))', 'CAST(l_partkey AS VARCHAR)')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c ON k = o_custkey",
        f"SELECT user_id, 'trace', {_td(chr(39) + 'j' + chr(39) + ' || user_id', 'event_id', 'event_type')} FROM events JOIN c ON k = user_id",
    ]
)


@query(f"WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m FROM customer), r AS ({_SQL_REPORT}) SELECT analysis_id, section, html FROM r")
def report_sections(spark, sf_dir):
    """All lines of a report a customer: its record, orders as evidence, lines as artifacts and edges, events as trace."""
    k = F.col("c_custkey")
    issue, rerun = F.when(k % 2 == 1, '{"code":"C","message":"m"}').otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(',"rerun_of":"a'), k, F.lit('"'))).otherwise("")
    payload = F.when(k % 5 == 0, "{broken").otherwise(F.format_string(_PAYLOAD, k, issue, rerun))
    day = lambda d: F.lit(f"1995-01-0{d} 00:00:00")
    analyses = read(spark, sf_dir, "customer").select(k.alias("analysis_id"), F.col("c_mktsegment").alias("status"), day(1).alias("created_at"), day(2).alias("updated_at"), payload.alias("payload"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("analysis_id"), "o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("task"))
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = line.select("analysis_id", F.concat(F.lit("p"), "l_partkey").alias("source"), F.col("evidence_id").alias("target"), F.lit("DERIVED_FROM").alias("edge_type"))
    artifacts = line.select("analysis_id", F.format_string("l%d_%d", "l_orderkey", "l_linenumber").alias("artifact_id"), "evidence_id", F.lit("image/tiff").alias("media_type"), F.sha2(F.col("l_orderkey").cast("string"), 256).alias("sha256"), F.col("l_partkey").alias("size_bytes"))
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("j"), "user_id").alias("job_id"), F.col("event_id").alias("sequence"), "event_type", F.col("ts").alias("created_at"))
    jobs = analyses.select(F.concat(F.lit("j"), "analysis_id").alias("job_id"), "analysis_id")
    rows = RP.report_rows(analyses, o, edges, artifacts, jobs, e)
    return rows.select("analysis_id", "section", RP.html(F.col("cells")).alias("html"))


@query(
    """WITH r AS (SELECT user_id AS job_id, min(ts) AS asked_at, count(*) AS n_requests FROM events WHERE event_type = 'purchase' OR event_id % 4 = 0 GROUP BY 1),
    j AS (SELECT c_custkey AS job_id, CASE c_custkey % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'CANCEL_REQUESTED' ELSE 'SUCCEEDED' END AS s FROM customer WHERE c_custkey % 11 <> 0),
    m AS (SELECT r.*, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s = 'QUEUED' THEN 'CANCELLED' WHEN s = 'RUNNING' THEN 'CANCEL_REQUESTED' ELSE 'CONFLICT' END AS outcome FROM r LEFT JOIN j USING (job_id))
    SELECT job_id, asked_at, n_requests, outcome, CASE WHEN outcome LIKE 'CANCEL%' THEN outcome END AS event FROM m"""
)
def cancel_outcomes(spark, sf_dir):
    k = F.col("c_custkey")
    status = F.when(k % 4 == 0, "QUEUED").when(k % 4 == 1, "RUNNING").when(k % 4 == 2, "CANCEL_REQUESTED").otherwise("SUCCEEDED")
    jobs = read(spark, sf_dir, "customer").where(k % 11 != 0).select(k.alias("job_id"), status.alias("status"))
    asked = read(spark, sf_dir, "events").where("event_type = 'purchase' or event_id % 4 = 0").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"))
    return JB.cancel_requests(jobs, asked).withColumnRenamed("at", "asked_at")


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 6 THEN l_shipdate END AS b, CASE WHEN l_linenumber < 6 THEN l_shipdate + to_days(CAST(l_quantity AS INTEGER)) END AS e, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 60 DAY END AS x
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey AS job_id, l_linenumber AS step, CASE WHEN x IS NULL THEN CASE WHEN b IS NULL THEN 'PENDING' WHEN e IS NULL THEN 'RUNNING' ELSE 'PUBLISHED' END WHEN b IS NULL OR x <= b THEN 'SKIPPED' WHEN e IS NULL OR x <= e THEN 'DISCARDED' ELSE 'PUBLISHED' END AS outcome FROM s"""
)
def step_outcomes(spark, sf_dir):
    """Lines of orders as steps of jobs, a third of which were cancelled 60 days after the order."""
    n = F.col("l_linenumber")
    ended = F.when(n < 6, F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int")))
    steps = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), n.alias("step"), F.when(n != 6, F.col("l_shipdate")).alias("started"), ended.alias("ended"))
    cancels = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("at"))
    return JB.step_outcomes(steps, cancels).select("job_id", "step", "outcome")


# A grid in degrees, and the map tiles asked of it: three over it, and one outside its level.
_DEGREES = (0.013, 0.0, 10.003, 0.0, -0.011, 45.207, 16, 16, 4326)
_ASKED = ((10, 540, 367), (11, 1081, 735), (12, 2163, 1471), (3, 9, 0))
_HALF = repr(math.pi * 6378137.0)


@query(
    f"""WITH {_SQL_RASTERS.split("g AS (SELECT")[0].rstrip().rstrip(",")},
    a AS (SELECT * FROM (VALUES {", ".join(f"({i}, {z}, {x}, {y})" for i, (z, x, y) in enumerate(_ASKED[:3]))}) t(k, z, x, y)),
    g AS (SELECT k, py, px, degrees(({_HALF} * 2 / pow(2, z) * (x + (px + 0.5) / 8) - {_HALF}) / 6378137.0) AS lon, degrees(atan(sinh(({_HALF} - {_HALF} * 2 / pow(2, z) * (y + (py + 0.5) / 8)) / 6378137.0))) AS lat FROM a, range(8) u(py), range(8) v(px)),
    p AS (SELECT k, py, px, (45.207 - lat) / 0.011 - 0.5 AS sr, (lon - 10.003) / 0.013 - 0.5 AS sc FROM g),
    d AS (SELECT observation, band, r, q, CASE WHEN v IS NOT NULL THEN least(floor(abs(v) * 1000), 255) END AS v FROM c),
    t AS (SELECT k, py, px, floor(sr) + i AS r, floor(sc) + j AS q, (CASE i WHEN 1 THEN sr - floor(sr) ELSE 1 - sr + floor(sr) END) * (CASE j WHEN 1 THEN sc - floor(sc) ELSE 1 - sc + floor(sc) END) AS w FROM p, range(2) a(i), range(2) b(j) WHERE sr BETWEEN -0.5 AND 15.5 AND sc BETWEEN -0.5 AND 15.5),
    m AS (SELECT observation, k, py, px, sum(v * w) / nullif(sum(w) FILTER (v IS NOT NULL), 0) AS v FROM t JOIN d USING (r, q) WHERE band = 0 AND observation % 4 = k GROUP BY ALL),
    n AS (SELECT observation, k, py, px, CASE WHEN v >= 50 THEN 255 ELSE 0 END AS v FROM p JOIN d ON d.r = least(floor(sr + 0.5), 15) AND d.q = least(floor(sc + 0.5), 15) WHERE band = 1 AND observation % 4 = k AND sr BETWEEN -0.5 AND 15.5 AND sc BETWEEN -0.5 AND 15.5),
    o AS (SELECT observation FROM c GROUP BY 1 HAVING count(DISTINCT band) = 2)
    SELECT observation AS pair, CAST(p.py * 8 + p.px AS INTEGER) AS i, CAST(coalesce(floor(m.v + 0.5), 0) AS INTEGER) AS red, CAST(coalesce(floor(m.v + 0.5), 0) AS INTEGER) AS blue, CAST(coalesce(n.v, 0) AS INTEGER) AS alpha
    FROM o JOIN p ON observation % 4 = k LEFT JOIN m USING (observation, k, py, px) LEFT JOIN n USING (observation, k, py, px)"""
)
def rendered_tiles(spark, sf_dir):
    """Map tiles of 8 x 8 cells of grey rasters in degrees, their second band as opacity."""
    shown = F.when(F.col("band") == 0, F.transform("data", lambda v: F.when(v.isNotNull(), F.least(F.floor(F.abs(v) * 1000), F.lit(255)).cast("double")))).otherwise(F.transform("data", lambda v: F.when(F.floor(F.abs(v) * 1000) >= 50, 255.0).otherwise(0.0)))
    t = _rasters(spark, sf_dir).withColumn("data", shown)
    k = (F.col("observation") % 4).cast("int")
    zxy = [F.get(F.array(*(F.lit(a[i]) for a in _ASKED)), k).alias(n) for i, n in enumerate("zxy")]
    asked = t.groupBy("observation").agg(F.countDistinct("band").alias("bands")).where("bands = 2").select(F.col("observation").alias("pair"), "observation", _grid(*_DEGREES[:8], crs=4326).alias("source"), *zxy)
    found = TL.render(t, asked, 8, (0,), 1, size=8)
    return found.select("pair", F.posexplode(F.arrays_zip("red", "blue", "alpha")).alias("i", "p")).select("pair", "i", "p.red", "p.blue", "p.alpha")


@query(
    f"""WITH {_SQL_RASTERS.split("g AS (SELECT")[0].rstrip().rstrip(",")}, s AS (SELECT *, observation // 2 % 2 AS x, observation % 2 AS y FROM (SELECT DISTINCT observation FROM c)),
    g AS (SELECT observation, u.i AS py, w.i AS px, y * 8 + u.i // 2 AS r, x * 8 + w.i // 2 AS q FROM s, range(16) u(i), range(16) w(i)),
    m AS (SELECT observation, r, q, CASE WHEN v > 0.1 THEN 1 WHEN v < -0.1 THEN 2 WHEN v < 0 THEN 7 ELSE 0 END AS v FROM c WHERE band = 0)
    SELECT observation AS pair, CAST(count(*) FILTER (v = 1) AS BIGINT) AS reds, CAST(count(*) FILTER (v = 2) AS BIGINT) AS blues, CAST(256 - count(*) FILTER (v IN (1, 2)) AS BIGINT) AS clear,
      CAST(coalesce(sum(CASE v WHEN 1 THEN (py * 16 + px + 1) * 200 WHEN 2 THEN (py * 16 + px + 1) * 90 END), 0) AS BIGINT) AS total FROM g LEFT JOIN m USING (observation, r, q) GROUP BY 1"""
)
def rendered_masks(spark, sf_dir):
    """Quarters of masks without a coordinate system, at double size; the value 7 has no colour."""
    value = lambda v: F.when(v > 0.1, 1.0).when(v < -0.1, 2.0).when(v < 0, 7.0).otherwise(0.0)
    t = _rasters(spark, sf_dir).withColumn("data", F.transform("data", value))
    o = F.col("observation")
    none = _grid(*_DEGREES[:8], crs=4326).withField("crs", F.lit(None).cast("int"))
    asked = t.select("observation").distinct().select(o.alias("pair"), "observation", none.alias("source"), F.lit(1).alias("z"), F.expr("observation div 2 % 2").alias("x"), (o % 2).alias("y"))
    found = TL.render_mask(t.where("band = 0"), asked, 8, {1: (200, 0, 0, 160), 2: (0, 0, 90, 160)}, size=16)
    n = lambda c, v: F.size(F.filter(c, lambda x: x == v)).cast("long")
    total = F.aggregate(F.transform(F.arrays_zip("red", "blue"), lambda p, i: ((i + 1) * (p["red"] + p["blue"])).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("pair", n("red", 200).alias("reds"), n("blue", 90).alias("blues"), n("alpha", 0).alias("clear"), total.alias("total"))


@query(
    """WITH e AS (SELECT vec_id // 2 AS tile, vec_id % 2 AS k, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    p AS (SELECT a.tile % 5 AS part, abs(b.v - a.v) >= 0.1 AS hit FROM e a JOIN e b USING (tile, pos) WHERE a.k = 0 AND b.k = 1 AND abs(a.v) >= 0.01 AND abs(b.v) >= 0.01),
    s AS (SELECT part, count(*) FILTER (hit) AS n FROM p GROUP BY 1)
    SELECT CAST(part AS INTEGER) AS part, part <> 4 AS answered, CASE part WHEN 4 THEN 'ABSTAIN' ELSE 'ALLOW' END AS outcome,
      CASE part WHEN 4 THEN 'I cannot provide a verified answer because the evidence did not pass verification.' ELSE 'The measured area is ' || printf('%.2f', n * 100.0 / 10000) || ' ha.' END AS answer FROM s"""
)
def planned_answers(spark, sf_dir):
    """Plans of a measured radar change over fifths of the tiles, run step by step and answered; the last one's check disagrees."""
    intent = {"task_family": "CHANGE_MEASURE", "target_semantic": "sar", "requested_measurement": "area"}
    plan = WF.make_plan(intent, ["first", "second"], {"domain": "db", "threshold": 0.1, "polarizations": ["vv"]})
    t, told = tile_pairs(spark, sf_dir), []
    for part in range(5):
        own = t.where(F.col("tile") % 5 == part)
        seen = {"first": own.select("tile", F.col("a").alias("vv")), "second": own.select("tile", F.col("b").alias("vv"))}
        measured = WF.execute(plan, seen)["area"]
        measured = measured.withColumn("recomputed", F.col("recomputed") + 1.0) if part == 4 else measured
        told.append(WF.answer(measured).select(F.lit(part).alias("part"), "answered", "outcome", "answer"))
    rows = told[0]
    for x in told[1:]:
        rows = rows.unionByName(x)
    return rows


@query("SELECT o_orderkey, o_orderstatus, o_custkey % 7 AS score FROM orders")
def strict_records(spark, sf_dir):
    """Orders written once as JSON lines and read back, every line strict."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 7).alias("score"))
    folder = f"{shared_folder(spark)}/records_{uuid.uuid4().hex}"
    ST.write_once(rows, folder, "json")
    return ST.json_lines(spark, folder, rows.schema)


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'VV,VH' WHEN 1 THEN 'HH' ELSE '' END AS polarizations,
    '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[' || format('[{0}.5,0.5],[{1}.5,0.5],[{1}.5,9.5],[{0}.5,9.5],[{0}.5,0.5]', c_custkey, c_custkey + 8) || ']]},"properties":{"crs":"' || CASE WHEN c_custkey % 2 = 0 THEN 'EPSG:3857' ELSE 'PIXEL_SPACE' END || '"}}' AS footprint FROM customer""")
def footprints(spark, sf_dir):
    """Footprints with and without a coordinate system, and polarisations of tags."""
    k = F.col("c_custkey")
    bounds = F.struct((k + 0.5).cast("double").alias("left"), F.lit(0.5).alias("bottom"), (k + 8.5).cast("double").alias("right"), F.lit(9.5).alias("top"))
    tag = F.when(k % 3 == 0, " vv;/VH ").when(k % 3 == 1, "hh").otherwise(" ,")
    t = read(spark, sf_dir, "customer").select("c_custkey", bounds.alias("bounds"), F.when(k % 2 == 0, "EPSG:3857").alias("crs"), tag.alias("tag"))
    return t.select("c_custkey", F.array_join(X.polarizations(F.col("tag")), ",").alias("polarizations"), ST.footprint().alias("footprint"))


# Customers as intents: a family, a target and a measurement each, with none to two observations and, mostly, a pair.
_INTENTS = (("CHANGE_MEASURE", "sar", "area"), ("CHANGE_VQA", None, None), ("MEASURE", None, "ndvi"), ("SINGLE_VQA", None, None), ("CROSS_MODAL_VQA", "sar", None), ("MEASURE", "water", "area"))
_SQL_FEASIBLE = f"""v(j, f, t, m) AS (VALUES {", ".join("(" + str(j) + ", " + ", ".join("NULL" if x is None else f"'{x}'" for x in i) + ")" for j, i in enumerate(_INTENTS))}),
    c AS (SELECT c_custkey AS k, v.*, k % 3 AS n, k % 5 <> 0 AS p, f LIKE 'CHANGE%' OR f LIKE 'CROSS%' AS temporal FROM customer JOIN v ON c_custkey % 6 = j),
    b AS (SELECT k, temporal AND NOT (n >= 2 AND p) AS c1, temporal AND p AND k % 7 = 0 AS c2, temporal AND p AND k % 11 = 0 AS c3, f IN ('MEASURE', 'CHANGE_MEASURE', 'CHANGE_LOCALIZE') AND p AND k % 13 IN (0, 1) AS c4,
      coalesce(m = 'ndvi', false) AND n > 0 AND k % 4 = 0 AS c5, coalesce(m = 'area', false) AND n > 0 AND k % 8 = 1 AS c6, (coalesce(t = 'sar', false) OR f = 'CROSS_MODAL_VQA') AND n > 0 AND k % 17 < 5 AS c7,
      f = 'SINGLE_VQA' AND n > 0 AND k % 9 = 3 AS c8, CASE f WHEN 'CROSS_MODAL_VQA' THEN true WHEN 'SINGLE_VQA' THEN k % 2 = 0 WHEN 'CHANGE_MEASURE' THEN k % 10 = 6 ELSE m = 'area' AND k % 10 = 6 END AS c9 FROM c)"""
_CHECKS = (("c1", "REQUEST_INPUT", "MISSING_TEMPORAL_PAIR"), ("c2", "REQUEST_INPUT", "TEMPORAL_ORDER_UNKNOWN"), ("c3", "REJECT", "NO_SPATIAL_OVERLAP"), ("c4", "REJECT", "PAIR_ALIGNMENT_INVALID"), ("c5", "REJECT", "MISSING_REQUIRED_BAND"), ("c6", "REJECT", "CRS_REQUIRED_FOR_MEASUREMENT"), ("c7", "REQUEST_INPUT", "UNKNOWN_SAR_POLARIZATION"), ("c8", "ALLOW_WITH_WARNING", "GEOREFERENCE_UNAVAILABLE"), ("c9", "ABSTAIN", "MODEL_UNAVAILABLE"))


@query(
    f"""WITH {_SQL_FEASIBLE} SELECT k, CASE WHEN c3 OR c4 OR c5 OR c6 THEN 'REJECT' WHEN c1 OR c2 OR c7 THEN 'REQUEST_INPUT' WHEN coalesce(c9, false) THEN 'ABSTAIN' WHEN c8 THEN 'ALLOW_WITH_WARNING' ELSE 'ALLOW' END AS outcome,
    concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, _, code in _CHECKS)}) AS codes FROM b"""
)
def feasible_intents(spark, sf_dir):
    """All nine checks of intents against observations, pairs and capabilities."""
    k = F.col("c_custkey")
    of = lambda i: F.get(F.array(*(F.lit(x[i]).cast("string") for x in _INTENTS)), (k % 6).cast("int"))
    intent = F.struct(*(of(i).alias(n) for i, n in enumerate(("task_family", "target_semantic", "requested_measurement"))))
    one = F.struct(
        F.when(k % 4 == 0, F.array(F.lit("Red"))).otherwise(F.array(F.lit("Red"), F.lit("B08"))).alias("descriptions"), F.when(k % 8 != 1, "EPSG:32633").alias("crs"), F.lit("sar").alias("kind"),
        F.when(k % 17 < 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("VV"))).alias("polarizations"), F.when(k % 17 > 4, "db").alias("domain"), F.lit(None).cast("string").alias("sensor"), (k % 9 == 3).alias("jpeg"),
    )
    pair = F.when(k % 5 != 0, F.struct((k % 7 != 0).alias("order_known"), F.lit(True).alias("overlap_known"), (k % 11 != 0).alias("sufficient"), F.when(k % 13 != 1, k % 13 != 0).alias("aligned")))
    state = lambda name, status: F.struct(F.lit(name).alias("id"), status.alias("status"))
    have = F.array(
        state("deterministic_sar_temporal_change", F.lit("AVAILABLE")), state("temporal_difference", F.lit("AVAILABLE")), state("spectral_index_ndvi", F.lit("AVAILABLE")),
        state("mask_area_measurement", F.when(k % 10 == 6, "BLOCKED").otherwise("AVAILABLE_WITH_LIMITS")), state("single_image_vqa", F.when(k % 2 == 0, "UNAVAILABLE_RUNTIME").otherwise("AVAILABLE")),
    )
    c = read(spark, sf_dir, "customer").select(k.alias("k"), intent.alias("intent"), F.array_repeat(one, (k % 3).cast("int")).alias("o"), pair.alias("pair"), have.alias("have"))
    x = c.select("k", FS.feasibility(F.col("intent"), F.col("o"), F.col("pair"), F.col("have")).alias("x"))
    codes = F.transform(F.filter("x.checks", lambda r: ~r["passed"]), lambda r: r["code"])
    return x.select("k", F.col("x.outcome").alias("outcome"), F.array_join(codes, ",").alias("codes"))
