"""Registered queries of the column functions over records, of stores and of the checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import checks as K
from .functions import numbers as N
from .functions import records as C
from .functions import text as X
from .operators import evidence as E
from .operators import metrics as M
from .operators import pairs as P
from .queries import _MICRO, query, read


def _box(*v):
    return F.struct(*(x.alias(k) for k, x in zip(("x1", "y1", "x2", "y2"), v)))


def _part(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", F.col("p_partkey").cast("double").alias("k"))


@query(f"SELECT c_custkey, {_MICRO.format('10.0 * (c_custkey % 50 + 0.5) + 2.0 * (c_nationkey + 0.5) + 7.5')} AS x, {_MICRO.format('1.0 * (c_custkey % 50 + 0.5) + 10.0 * (c_nationkey + 0.5) + 3.25')} AS y FROM customer")
def pixel_to_world(spark, sf_dir):
    grid = F.struct(*(F.lit(v).alias(k) for k, v in zip("abcdef", (10.0, 2.0, 7.5, 1.0, 10.0, 3.25))))
    p = N.pixel_to_world(grid, F.col("c_custkey") % 50, F.col("c_nationkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", N.micro(p["x"]).alias("x"), N.micro(p["y"]).alias("y"))


@query(f"SELECT p_partkey, {_MICRO.format('1 / (1 + exp(-(p_size - 25) / 5.0))')} AS p, 1 / (1 + exp(-(p_size - 25) / 5.0)) >= 0.5 AS chosen FROM part")
def sigmoid_decisions(spark, sf_dir):
    p = N.sigmoid((F.col("p_size") - 25) / 5.0)
    return read(spark, sf_dir, "part").select("p_partkey", N.micro(p).alias("p"), (p >= 0.5).alias("chosen"))


@query("SELECT p_partkey, CAST(round_even(p_size / 2.0, 0) AS BIGINT) AS half, abs(p_size - p_partkey) <= greatest(0.5 * greatest(p_size, p_partkey), 3) AS near FROM part")
def rounded_and_near(spark, sf_dir):
    a, b = F.col("p_size").cast("double"), F.col("p_partkey").cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", N.round_half_even(a / 2.0).cast("long").alias("half"), N.is_close(a, b, 0.5, 3.0).alias("near"))


@query(
    f"""WITH b AS (SELECT p_partkey, p_partkey % 7 AS a, p_partkey % 5 AS b, p_partkey % 7 + 4.0 AS c, p_partkey % 5 + 3.0 AS d FROM part), i AS (SELECT *, greatest(least(c, 8) - greatest(a, 2), 0) * greatest(least(d, 6) - greatest(b, 1), 0) AS i FROM b)
    SELECT p_partkey, {_MICRO.format('i / (12.0 + 30.0 - i)')} AS iou, CAST((c - a) * (d - b) AS BIGINT) AS area FROM i"""
)
def box_iou_area(spark, sf_dir):
    k = F.col("p_partkey")
    b = _box(k % 7 + 0.0, k % 5 + 0.0, k % 7 + 4.0, k % 5 + 3.0)
    return read(spark, sf_dir, "part").select("p_partkey", N.micro(N.box_iou(b, _box(*map(F.lit, (2.0, 1.0, 8.0, 6.0))))).alias("iou"), N.box_area(b).cast("long").alias("area"))


@query(
    """WITH b AS (SELECT p_partkey, p_partkey % 9 - 3.0 AS a, p_partkey % 6 - 2.0 AS b, p_partkey % 9 + 1.0 AS c, p_partkey % 6 + 2.0 AS d FROM part), i AS (SELECT *, greatest(a, 0) AS x1, greatest(b, 0) AS y1, least(c, 6) AS x2, least(d, 5) AS y2 FROM b)
    SELECT p_partkey, CASE WHEN x2 > x1 AND y2 > y1 THEN CAST(x1 AS DOUBLE) END AS x1, CASE WHEN x2 > x1 AND y2 > y1 THEN CAST(y2 AS DOUBLE) END AS y2, CAST(c * 2 AS DOUBLE) AS wide, CAST(d * 3 AS DOUBLE) AS high FROM i"""
)
def box_clip_scale(spark, sf_dir):
    k = F.col("p_partkey")
    b = _box(k % 9 - 3.0, k % 6 - 2.0, k % 9 + 1.0, k % 6 + 2.0)
    cut, wide = C.clip_box(b, F.lit(6.0), F.lit(5.0)), C.scale_box(b, F.lit(2.0), F.lit(3.0))
    return read(spark, sf_dir, "part").select("p_partkey", cut["x1"].alias("x1"), cut["y2"].alias("y2"), wide["x2"].alias("wide"), wide["y2"].alias("high"))


@query(
    """WITH s AS (SELECT p_partkey, p_size + 10.0 AS w, p_partkey % 97 + 5.0 AS h FROM part), r AS (SELECT *, least(64.0 / w, 40.0 / h) AS f, least(80.0 / least(w, h), 133.0 / greatest(w, h)) AS e FROM s)
    SELECT p_partkey, CAST(greatest(1, round_even(w * f, 0)) AS INTEGER) AS fit_w, CAST(greatest(1, round_even(h * f, 0)) AS INTEGER) AS fit_h, CAST(greatest(1, round_even(w * e, 0)) AS INTEGER) AS edge_w, CAST(greatest(1, round_even(h * e, 0)) AS INTEGER) AS edge_h FROM r"""
)
def input_sizes(spark, sf_dir):
    w, h = F.col("p_size") + 10.0, F.col("p_partkey") % 97 + 5.0
    a, b = C.fitted_size(w, h, 64, 40), C.short_edge_size(w, h, 80, 133)
    return read(spark, sf_dir, "part").select("p_partkey", a["width"].alias("fit_w"), a["height"].alias("fit_h"), b["width"].alias("edge_w"), b["height"].alias("edge_h"))


@query(
    """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST((CAST(unnest(embedding) AS DOUBLE) - 0.1) / 0.5 AS FLOAT) AS z FROM embeddings)
    SELECT vec_id, CASE WHEN vec_id % 7 > 0 THEN CAST(sum(i * CAST(floor(CAST(z AS DOUBLE) * 1e3 + 0.5) AS BIGINT)) AS BIGINT) END AS total, CASE WHEN vec_id % 7 > 0 THEN count(*) END AS n FROM e GROUP BY vec_id"""
)
def standardised_bands(spark, sf_dir):
    """The standardised values themselves, summed by place; one band of every seventh tile has a masked cell and gives none."""
    x = F.col("embedding").cast("array<double>")
    odd = F.when(F.col("vec_id") % 7 == 0, F.concat(F.slice(x, 1, 63), F.array(F.lit(None).cast("double")))).otherwise(x)
    e = read(spark, sf_dir, "embeddings").select("vec_id", C.standardised(odd, 0.1, 0.5).alias("z"))
    each = F.transform("z", lambda v, i: (i + 1).cast("long") * F.floor(v.cast("double") * 1e3 + 0.5).cast("long"))
    return e.select("vec_id", F.aggregate(each, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.when(F.col("z").isNotNull(), F.size("z")).cast("long").alias("n"))


@query("SELECT p_partkey, CAST(list_contains(w, 'green') AS INTEGER) AS green, CAST(list_contains(w, 'red') AS INTEGER) AS red, CAST(list_contains(w, 'nowhere') AS INTEGER) AS nowhere, array_to_string(list_sort(list_distinct(w)), ',') AS labels FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def one_hot_labels(spark, sf_dir):
    words, classes = F.split("p_name", " "), ("green", "red", "nowhere")
    hot = C.one_hot(words, classes)
    return read(spark, sf_dir, "part").select("p_partkey", *(F.get(hot, F.lit(i)).alias(c) for i, c in enumerate(classes)), F.array_join(C.sorted_distinct(words), ",").alias("labels"))


_SEEN = """(SELECT lang, doc_id % 6 = 0 AS second, CASE n_chars % 4 WHEN 0 THEN ' Yes.' ELSE 'no' END AS answer, CASE n_chars % 5 WHEN 0 THEN 'YES' ELSE 'No!' END AS correct, CASE n_chars % 7 WHEN 0 THEN 'yes' ELSE 'no' END AS blank, CASE n_chars % 3 WHEN 0 THEN 'yes' ELSE 'no' END AS shuffled FROM documents)"""


@query(
    f"""WITH n AS (SELECT lang, second, trim(regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(correct), '[^a-z0-9]+', ' ', 'g')) AS c, blank AS b, shuffled AS s FROM {_SEEN}),
    v AS (SELECT lang, second, count(*) AS n, avg(CAST(c = a AS DOUBLE)) - greatest(avg(CAST(b = a AS DOUBLE)), avg(CAST(s = a AS DOUBLE))) AS gap, count(*) FILTER (c <> s) AS differing, count(*) FILTER (c = a AND s <> a) AS correct_wins, count(*) FILTER (c <> a AND s = a) AS shuffled_wins FROM n GROUP BY ALL)
    SELECT x.lang, x.n, {_MICRO.format('x.gap')} AS gap, x.differing, x.correct_wins, x.shuffled_wins, {_MICRO.format('y.gap - x.gap')} AS gain, y.gap - x.gap >= 0.05 AS improved FROM v x JOIN v y ON x.lang = y.lang AND NOT x.second AND y.second"""
)
def visual_dependence(spark, sf_dir):
    """Answers of two systems with the right image, a blank and another scene's; the second has a sixth of the documents."""
    yes = lambda m, a, b: F.when(F.col("n_chars") % m == 0, a).otherwise(b)
    d = read(spark, sf_dir, "documents").select("lang", "doc_id", yes(4, " Yes.", "no").alias("answer"), yes(5, "YES", "No!").alias("correct"), yes(7, "yes", "no").alias("blank"), yes(3, "yes", "no").alias("shuffled"))
    second = F.col("doc_id") % 6 == 0
    a, b = (M.visual_dependence(d.where(x), ["lang"]) for x in (~second, second))
    met = a.join(M.materially_improved(a, b, ["lang"]), "lang")
    return met.select("lang", "n", N.micro(F.col("gap")).alias("gap"), "differing", "correct_wins", "shuffled_wins", N.micro(F.col("gain")).alias("gain"), "improved")


@query("SELECT page_id, CASE WHEN last NOT IN ('', '.', '..') THEN last END AS name FROM (SELECT page_id, string_split(replace(url, '\\', '/'), '/')[-1] AS last FROM pages)")
def file_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.file_name(F.col("url")).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS first, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey + 9 END AS total FROM orders")
def content_ranges(spark, sf_dir):
    k = F.col("o_custkey")
    text = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("bytes "), k, F.lit("-"), k + 8, F.lit("/"), k + 9)).otherwise(F.lit("bytes */7"))
    r = C.content_range(text)
    return read(spark, sf_dir, "orders").select("o_orderkey", r["first"].alias("first"), r["total"].alias("total"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'sar' WHEN 1 THEN 'optical' ELSE 'unknown' END AS modality, CASE WHEN c_nationkey % 2 = 0 THEN 'p' || c_nationkey ELSE c_name END AS platform FROM customer")
def record_tags(spark, sf_dir):
    """Tags of several spellings of one name, some of them blank."""
    n = F.col("c_nationkey")
    tags = F.create_map(F.lit("a:plat-form"), F.when(n % 2 == 0, F.concat(F.lit(" p"), n)).otherwise(F.lit(" ")), F.lit("Platform"), F.when(n % 2 == 0, F.lit("")).otherwise(F.col("c_name")))
    kind = F.when(F.col("c_custkey") % 3 == 0, " Radar").when(F.col("c_custkey") % 3 == 1, "RGB").otherwise("lidar")
    return read(spark, sf_dir, "customer").select("c_custkey", C.modality(kind).alias("modality"), C.first_tag(tags, "SENSOR", "PLATFORM").alias("platform"))


@query("SELECT z, count(*) FILTER (x < 1 << z AND y < 1 << z) AS inside FROM (SELECT CAST(s_suppkey % 6 AS INTEGER) AS z, s_nationkey AS x, s_suppkey % 11 AS y FROM supplier) GROUP BY z")
def tiles_in_domain(spark, sf_dir):
    z, x, y = F.col("s_suppkey") % 6, F.col("s_nationkey"), F.col("s_suppkey") % 11
    return read(spark, sf_dir, "supplier").select(z.cast("int").alias("z"), C.tile_in_domain(z, x, y).alias("ok")).groupBy("z").agg(F.count_if("ok").alias("inside"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NIR' WHEN 1 THEN 'RED' WHEN 2 THEN 'NIR,RED' ELSE '' END AS missing, CASE WHEN p_partkey % 2 = 0 THEN '1' WHEN p_partkey % 4 = 1 THEN '1,2,3' ELSE '3,2,1' END AS shown FROM part")
def bands_by_role(spark, sf_dir):
    k = F.col("p_partkey") % 4
    names = F.when(k == 0, F.array(F.lit("B04"), F.lit(None).cast("string"))).when(k == 1, F.array(F.lit("Near-Infrared"))).when(k == 2, F.array(F.lit("blue"))).otherwise(F.array(F.lit("red"), F.lit("B8")))
    colours = F.when(k == 3, F.array(*map(F.lit, ("blue", "green", "red")))).otherwise(F.array(*map(F.lit, ("a", "b", "c"))))
    shown = C.display_bands(F.when(k % 2 == 0, "sar").otherwise("optical"), F.lit(3), colours)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(C.missing_bands(("RED", "NIR"), names), ",").alias("missing"), F.array_join(shown.cast("array<string>"), ",").alias("shown"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, arg_min(event_type, (-n, f)) AS majority FROM c GROUP BY user_id")
def majority_answer(spark, sf_dir):
    return M.majority(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'INTERRUPTED' ELSE o_orderstatus END AS status FROM orders")
def restart_recovery(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise(F.col("o_orderstatus"))
    return E.interrupted(read(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'NEW' WHEN c_nationkey % 2 = 0 THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM customer")
def idempotent_submit(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key_hash"), F.col("c_nationkey").alias("n"))
    known = c.where("c_custkey % 2 = 0").select("key_hash", (F.col("n") - F.col("n") % 2).cast("string").alias("request_hash"))
    return E.submissions(known, c.select("c_custkey", "key_hash", F.col("n").cast("string").alias("request_hash"))).select("c_custkey", "outcome")


@query("WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT a.c_custkey, b.c_custkey AS other FROM n a JOIN n b ON b.i = (a.i + 1) % a.n")
def scene_derangement(spark, sf_dir):
    return E.derangement(read(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'RUNNING' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE o_orderstatus END AS status, o_orderstatus = 'O' AND o_custkey % 3 = 0 AS won FROM orders")
def state_transition(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise(F.col("o_orderstatus")).alias("status"), F.lit(1).alias("updated_at"))
    return E.transition(rows, "o_orderkey", "QUEUED", "RUNNING", o.where("o_custkey % 3 = 0"), E.JOB_TRANSITIONS, F.lit(2)).select("o_orderkey", "status", "won")


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'DUPLICATE_OBSERVATION' WHEN s_suppkey % 7 = 0 THEN 'DUPLICATE_ASSET' WHEN s_nationkey = 0 THEN 'NO_SPATIAL_OVERLAP' WHEN s_suppkey % 5 = 0 THEN 'TEMPORAL_ORDER_CONFLICT'
      WHEN s_suppkey % 3 = 0 THEN 'TEMPORAL_ORDER_UNKNOWN' WHEN s_nationkey % 2 = 0 THEN 'PAIR_TYPE_MISMATCH' WHEN s_nationkey % 5 = 0 THEN 'PAIR_INCOMPATIBLE' END AS code FROM supplier"""
)
def endpoint_policy(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    code = P.endpoint_outcome(k % 11 == 0, k % 7 == 0, n.cast("double"), k % 3 != 0, k % 5 != 0, n % 2 != 0, F.when(n % 5 == 0, "FAIL").otherwise("PASS"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", code.alias("code"))


@query("(SELECT c_nationkey AS k, 'first' AS side FROM customer EXCEPT ALL SELECT s_nationkey, 'first' FROM supplier) UNION ALL (SELECT s_nationkey, 'second' FROM supplier EXCEPT ALL SELECT c_nationkey, 'second' FROM customer)")
def set_equality(spark, sf_dir):
    return E.set_difference(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query(
    f"""WITH t AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type), ' ') || [string_split(p_name, ' ')[1]]) AS b FROM part)
    SELECT p_partkey, {_MICRO.format('2.0 * len(list_intersect(a, b)) / (len(a) + len(b))')} AS f1 FROM t"""
)
def sample_set_f1(spark, sf_dir):
    a = F.array_distinct(F.split("p_name", " "))
    b = F.array_distinct(F.concat(F.split(F.lower("p_type"), " "), F.array(F.get(F.split("p_name", " "), F.lit(0)))))
    return read(spark, sf_dir, "part").select("p_partkey", N.micro(M.sample_f1(a, b)).alias("f1"))


@query("SELECT c_custkey, rtrim(trim(regexp_replace(lower(c_name || '  #' || c_nationkey || '..'), '\\s+', ' ', 'g')), '.') || '.' AS phrase FROM customer")
def query_phrases(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", X.query_phrase(F.concat("c_name", F.lit("  #"), "c_nationkey", F.lit(".."))).alias("phrase"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS t FROM events")
def acquisition_times(spark, sf_dir):
    """Text with an offset is a time; without one it is none."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 > 0, F.lit("+00:00")).otherwise(F.lit("")))
    return read(spark, sf_dir, "events").select("event_id", F.date_format(X.acquisition_time(text), "yyyy-MM-dd HH:mm").alias("t"))


@query("WITH p AS (SELECT n_nationkey, n_name, band, '/d/' || n_nationkey % 20 || '_' || band || '.tif' AS path FROM nation, (VALUES ('B02'), ('B03')) b(band)) SELECT *, count(*) OVER (PARTITION BY path) > 1 AS refused FROM p")
def paths_by_band(spark, sf_dir):
    """Paths of samples and bands; five nations share theirs with others and are refused."""
    from .sources.tables import repeated_paths, samples_by_band

    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") % 20).cast("string").alias("sample_id"))
    p = samples_by_band(n, ["B02", "B03"], "/d/{id}_{band}.tif").drop("sample_id")
    return p.join(repeated_paths(p), "path", "left").select("n_nationkey", "n_name", "band", "path", F.col("n").isNotNull().alias("refused"))


@query(
    "SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || user_id || chr(10) || chr(10) AS frame FROM events"
)
def event_frames(spark, sf_dir):
    from .streaming.events import frames

    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_id").alias("sequence"), "event_type", F.col("user_id").cast("string").alias("payload"))
    return frames(e).select(F.col("sequence").alias("event_id"), "frame")


@query("SELECT p_partkey, p_size <= 30 AND p_partkey % 40 < 35 AND p_size * (p_partkey % 40) <= 600 AS allowed FROM part")
def resource_limits(spark, sf_dir):
    ok = K.within_limits({"width": (F.col("p_size"), 30), "height": (F.col("p_partkey") % 40, 34), "pixels": (F.col("p_size") * (F.col("p_partkey") % 40), 600)})
    return read(spark, sf_dir, "part").select("p_partkey", (F.size(ok) == 0).alias("allowed"))


@query("SELECT p_partkey, p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 13 <= 10 AND p_size % 9 <> 0 AND p_size % 50 < 40 AS kept FROM part")
def detection_drop(spark, sf_dir):
    """Blank phrases, scores that are no number or beyond 1, boxes without an area and boxes outside the image go."""
    k, s = F.col("p_partkey"), F.col("p_size")
    score = F.when(k % 4 == 0, F.lit(float("nan"))).otherwise((k % 13) / 10.0)
    phrase = F.when(k % 5 == 0, F.lit(" \t")).otherwise(F.col("p_name"))
    left = F.lit(50.0) * (s % 50 >= 40).cast("double")
    b = _box(left, F.lit(1.0), left + F.when(s % 9 == 0, 0.0).otherwise(3.0), F.lit(5.0))
    return read(spark, sf_dir, "part").select("p_partkey", K.usable_detection(score, phrase, b, F.lit(40.0), F.lit(40.0)).alias("kept"))


@query("SELECT c_custkey, regexp_full_match(k, '[A-Za-z0-9._-]{16,128}') AS allowed FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'key/' || c_name WHEN 1 THEN 'k:' || replace(c_name, '#', '-') WHEN 2 THEN repeat('ab', 40 + c_custkey % 50) WHEN 3 THEN 'k' || c_custkey ELSE replace(c_name, '#', '_.') END AS k FROM customer)")
def id_guard(spark, sf_dir):
    """Keys with a slash, with a colon, of 80 to 178 letters, short ones and plain ones."""
    k, name = F.col("c_custkey") % 5, lambda by: F.replace(F.col("c_name"), F.lit("#"), F.lit(by))
    key = F.when(k == 0, F.concat(F.lit("key/"), "c_name")).when(k == 1, F.concat(F.lit("k:"), name("-"))).when(k == 2, F.repeat(F.lit("ab"), (F.col("c_custkey") % 50 + 40).cast("int"))).when(k == 3, F.concat(F.lit("k"), "c_custkey")).otherwise(name("_."))
    return read(spark, sf_dir, "customer").select("c_custkey", K.plain_id(key).alias("allowed"))


@query("SELECT vec_id, vec_id % 5 = 0 AS refused FROM embeddings")
def mask_values(spark, sf_dir):
    """A mask that holds anything but 0 and 1 is refused."""
    mask = F.transform(F.col("embedding").cast("array<double>"), lambda v: (v > 0).cast("double"))
    odd = F.when(F.col("vec_id") % 5 == 0, F.concat(mask, F.array(F.lit(2.0)))).otherwise(mask)
    return read(spark, sf_dir, "embeddings").select("vec_id", (~K.binary_mask(odd)).alias("refused"))


@query("SELECT p_partkey, p_size % 2 = 0 AS accepted FROM part")
def strict_zip(spark, sf_dir):
    a = F.sequence(F.lit(1), F.col("p_size"))
    b = F.sequence(F.lit(1), F.col("p_size") + F.col("p_size") % 2)
    return read(spark, sf_dir, "part").select("p_partkey", K.strict_zip(a, b).isNotNull().alias("accepted"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id * 7919 % 101 AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    r AS (SELECT user_id, i, m AS best, event_id AS best_at, 0 AS stale, event_id AS stopped_at FROM e WHERE i = 1
      UNION ALL SELECT r.user_id, e.i, CASE WHEN e.m > best + 5 THEN e.m ELSE best END, CASE WHEN e.m > best + 5 THEN e.event_id ELSE best_at END, CASE WHEN e.m > best + 5 THEN 0 ELSE stale + 1 END, e.event_id FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1 WHERE stale <= 2)
    SELECT user_id, best, best_at, stopped_at FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""
)
def running_best(spark, sf_dir):
    """The best metric of a run that ends with the third row without a gain of more than 5."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 101).alias("m"))
    return M.running_best(e, "user_id", "event_id", "m", patience=2, min_delta=5)


@query(
    f"""WITH x AS (SELECT label, abs(embedding[1]) * 2 AS a, abs(embedding[2]) * 2.2 AS b, abs(embedding[3]) * 2.6 AS c FROM embeddings),
    m AS (SELECT label, avg(CAST(a AS DOUBLE)) AS ma, avg(CAST(b AS DOUBLE)) AS mb, avg(CAST(c AS DOUBLE)) AS mc, avg(CAST(a >= 0.25 AS DOUBLE)) AS qa, avg(CAST(b >= 0.25 AS DOUBLE)) AS qb, avg(CAST(c >= 0.25 AS DOUBLE)) AS qc FROM x GROUP BY label)
    SELECT label, mc > mb AND qc > qb AS accepted, {_MICRO.format('mc - ma')} AS iou_to_first, {_MICRO.format('qc - qa')} AS acc_to_first, {_MICRO.format('mc - mb')} AS iou_to_chosen, {_MICRO.format('qc - qb')} AS acc_to_chosen FROM m"""
)
def guardrail_accept(spark, sf_dir):
    """Three policies by label: the last is accepted where its mean and its share of hits are both better than the second's."""
    v = lambda i, f: F.abs(F.get("embedding", F.lit(i))) * f
    e = read(spark, sf_dir, "embeddings").select("label", v(0, 2).alias("a"), v(1, 2.2).alias("b"), v(2, 2.6).alias("c"))
    policy = lambda k: F.struct(F.avg(F.col(k).cast("double")).alias("mean_iou"), F.avg((F.col(k) >= 0.25).cast("double")).alias("acc_50")).alias(k)
    g = e.groupBy("label").agg(*map(policy, "abc")).withColumn("g", K.guardrail(F.col("c"), F.col("a"), F.col("b")))
    return g.select("label", "g.accepted", *(N.micro(F.col(f"g.to_{p}.{m}")).alias(f"{n}_to_{p}") for p in ("first", "chosen") for m, n in (("mean_iou", "iou"), ("acc_50", "acc"))))


@query(
    """WITH n AS (SELECT o_custkey AS payload, o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
    m AS (SELECT payload, bool_or(before IS NULL AND payload % 5 = 0 OR k % 11 = 0 AND payload % 3 = 0) AS miss FROM n GROUP BY payload)
    SELECT 'new' || k AS evidence_id, CASE WHEN NOT miss THEN coalesce('new' || before, 'again' || payload) || CASE WHEN k % 2 = 0 THEN ',new' || k ELSE '' END END AS parents,
      CASE WHEN NOT miss AND k % 11 = 0 THEN 'again' || payload END AS source, miss FROM n JOIN m USING (payload)"""
)
def replay_remap(spark, sf_dir):
    """A payload a customer: its orders as nodes, each after the one before; the first one's parent was replayed for four of five customers, a source for two of three."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    k, old = F.col("o_orderkey"), lambda c: F.concat(F.lit("old"), c)
    before = F.coalesce(old(F.lag("o_orderkey").over(w)), F.concat(F.lit("gone"), "o_custkey"))
    source = F.when(k % 11 == 0, F.concat(F.lit("held"), "o_custkey"))
    parents = F.when(k % 2 == 0, F.array(before, old(k))).otherwise(F.array(before))
    none = F.lit(None).cast("string")
    n = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("payload"), old(k).alias("evidence_id"), F.concat(F.lit("new"), k).alias("new_id"), parents.alias("parents"), source.alias("source_evidence_id"), none.alias("first_evidence_id"), none.alias("second_evidence_id"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("again"), "c_custkey").alias("new"))
    replayed = c.where("c_custkey % 5 <> 0").select(F.concat(F.lit("gone"), "c_custkey").alias("old"), "new").union(c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("held"), "c_custkey").alias("old"), "new"))
    return E.remapped(n, replayed).select("evidence_id", F.array_join("parents", ",").alias("parents"), F.col("source_evidence_id").alias("source"), "miss")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def conjunctive_filter(spark, sf_dir):
    """A filter of the fields that are given; null ones do not count."""
    asked = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_clerk": None}
    return K.matching(read(spark, sf_dir, "orders"), asked).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey = 7")
def primary_key_lookup(spark, sf_dir):
    return K.matching(read(spark, sf_dir, "customer"), {"c_custkey": 7}).select("c_custkey")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 2")
def most_common(spark, sf_dir):
    return M.distribution(read(spark, sf_dir, "events"), "event_type").select("event_type", "n").orderBy(F.col("n").desc(), "event_type").limit(2)


@query(
    """WITH p AS (SELECT o_orderdate AS t, o_orderkey AS k FROM orders WHERE o_custkey % 40 = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50), n AS (SELECT count(*) AS n, arg_min(strftime(t, '%Y-%m-%dT%H:%M:%S.%fZ'), (t, k)) AS t, arg_min(k, (t, k)) AS k FROM p)
    SELECT CASE WHEN n = 50 THEN rtrim(translate(to_base64(encode('{"t":"' || t || '","k":' || k || '}')), '+/', '-_'), '=') END AS cursor, n FROM n
    UNION ALL SELECT NULL, count(*) FROM (SELECT 1 FROM orders WHERE o_orderkey <= 7)"""
)
def page_cursors(spark, sf_dir):
    """The cursor after a full page, and none after one of fewer rows."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    made = []
    for rows in (o.where("o_custkey % 40 = 1"), o.where("o_orderkey <= 7")):
        p = E.page(rows, "t", "o_orderkey", 50)
        made.append(E.next_cursor(p, "t", "o_orderkey", 50).crossJoin(p.agg(F.count("*").alias("n"))))
    return made[0].union(made[1])


@query(
    """WITH c AS (SELECT c_custkey, sha256('step' || c_custkey) AS h, c_custkey % 8 AS m FROM customer),
    f AS (SELECT s_suppkey FROM supplier)
    SELECT CASE WHEN m = 5 THEN upper(h) ELSE h END AS cache_key, CASE WHEN m IN (0, 1, 7) THEN false WHEN m IN (2, 5, 6) THEN false WHEN m = 4 THEN true ELSE s_suppkey IS NOT NULL END AS hit FROM c LEFT JOIN f ON s_suppkey = c_custkey % 100"""
)
def cache_lookup(spark, sf_dir):
    """Results kept by a digest: no entry (0), another entry only (1), no object (2), a file that may be there (3), no files (4), no digest (5), another hash (6), an artifact without one (7)."""
    k, m = F.col("c_custkey"), F.col("c_custkey") % 8
    h = F.sha2(F.concat(F.lit("step"), k.cast("string")), 256)
    name, sha = (k % 100).cast("string"), lambda x: F.sha2(F.concat(F.lit("file"), x), 256)
    art = lambda body: F.concat(F.lit('{"artifacts": [{"artifact_id": "'), name, F.lit('"'), body, F.lit("}]}"))
    payload = F.when(m == 2, "[1]").when(m == 4, '{"value": 1, "artifacts": []}').when(m == 7, art(F.lit(""))).otherwise(art(F.concat(F.lit(', "sha256": "'), F.when(m == 6, sha(F.lit("x"))).otherwise(sha(name)), F.lit('"'))))
    c = read(spark, sf_dir, "customer")
    entries = c.where(m > 0).select(F.when(m == 1, F.sha2("c_name", 256)).when(m == 5, F.upper(h)).otherwise(h).alias("cache_key"), payload.alias("payload"))
    files = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("artifact_id")).withColumn("sha256", sha(F.col("artifact_id")))
    return E.cached(c.select(F.when(m == 5, F.upper(h)).otherwise(h).alias("cache_key")), entries, files).select("cache_key", "hit")


@query(
    """WITH n AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN '/' || url WHEN 1 THEN 'a/../b' WHEN 2 THEN 'a\b' WHEN 3 THEN 'C:/x' WHEN 4 THEN './' WHEN 5 THEN 'a//b/./' || page_id WHEN 6 THEN '' ELSE 'd/' || page_id || '.tif' END AS name, CASE WHEN page_id % 4 = 0 THEN 'symlink' WHEN page_id % 4 = 1 THEN 'dir' ELSE 'file' END AS kind FROM pages)
    SELECT page_id, CASE WHEN page_id % 9 = 2 THEN 'separator' WHEN page_id % 9 IN (0, 1, 3, 4, 6) THEN 'path' WHEN kind = 'symlink' THEN 'kind' END AS refusal FROM n"""
)
def archive_members(spark, sf_dir):
    k = F.col("page_id")
    names = (F.concat(F.lit("/"), "url"), F.lit("a/../b"), F.lit("a\\b"), F.lit("C:/x"), F.lit("./"), F.concat(F.lit("a//b/./"), k), F.lit(""))
    name = F.concat(F.lit("d/"), k, F.lit(".tif"))
    for i, x in enumerate(names):
        name = F.when(k % 9 == i, x).otherwise(name)
    kind = F.when(k % 4 == 0, "symlink").when(k % 4 == 1, "dir").otherwise("file")
    return read(spark, sf_dir, "pages").select("page_id", K.member_refusal(name, kind).alias("refusal"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > declared THEN 'exceeds declared size' WHEN declared IS NULL OR octet_length(encode(text)) <> declared THEN 'size mismatch' END AS fault FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 < 4 THEN octet_length(encode(text)) + doc_id % 5 - CASE WHEN doc_id % 5 = 3 THEN 4 ELSE 0 END END AS declared FROM documents)")
def copied_sizes(spark, sf_dir):
    n, k = F.octet_length("text").cast("long"), F.col("doc_id") % 5
    declared = F.when(k < 4, n + k - F.when(k == 3, 4).otherwise(0))
    return read(spark, sf_dir, "documents").select("doc_id", K.copy_fault(n, declared).alias("fault"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'INVALID' WHEN 1 THEN 'MISMATCH' ELSE 'REUSE' END AS outcome FROM supplier")
def marker_reuse(spark, sf_dir):
    """Markers that are no object, that lack a field or differ in one, and that agree, with a field more."""
    k = F.col("s_suppkey")
    body = lambda n: F.to_json(F.struct(F.lit("m").alias("manifest_sha256"), F.col("s_name").alias("modality"), F.lit("a").alias("archive_md5"), k.alias("compressed_bytes_streamed"), n.alias("selected_members"), F.lit(5).alias("extracted_bytes")))
    marker = F.when(k % 8 == 0, "[]").when(k % 4 == 0, "{").when(k % 8 == 1, "{}").when(k % 4 == 1, body(k + 1)).otherwise(body(k))
    need = F.struct(F.lit("m").alias("manifest_sha256"), F.col("s_name").alias("modality"), F.lit("a").alias("archive_md5"), k.alias("compressed_bytes_streamed"), k.alias("selected_members"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", K.marker_outcome(marker, need).alias("outcome"))


@query(
    """WITH e AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS i, 'lines.' || l_linenumber || '.quantity:' || l_returnflag AS x FROM lineitem)
    SELECT l_orderkey, string_agg(x, ',' ORDER BY i) AS told FROM e WHERE i <= 3 GROUP BY l_orderkey"""
)
def error_details(spark, sf_dir):
    """Of the errors of an order's lines (the value is never told), the first three."""
    e = F.struct(F.array(F.lit("lines"), F.col("l_linenumber").cast("string"), F.lit("quantity")).alias("loc"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("input"))
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", e.alias("e")))).alias("e"))
    told = K.validation_details(F.transform("e", lambda x: x["e"]), 3)
    return g.select("l_orderkey", F.array_join(F.transform(told, lambda t: F.concat_ws(":", t["field"], t["category"])), ",").alias("told"))


@query(
    """WITH c AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, avg(n_chars) AS size FROM documents GROUP BY lang)
    SELECT lang, concat_ws(',', CASE WHEN lang = 'de' THEN 'n' END, CASE WHEN lang = 'fr' THEN 'size' END) AS odd FROM c"""
)
def anchor_reproduction(spark, sf_dir):
    """Figures of a run against anchors: one count differs in one language, one metric by more than the tolerance in another."""
    c = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.avg("n_chars").alias("size"))
    shift = F.when(F.col("lang") == "fr", 2e-4).otherwise(5e-5)
    odd = K.reproduced({"n": (F.col("n"), F.col("n") + (F.col("lang") == "de").cast("int")), "sources": (F.col("sources"), F.col("sources"))}, {"size": (F.col("size"), F.col("size") + shift)})
    return c.select("lang", F.array_join(odd, ",").alias("odd"))


@query(
    """WITH a AS (SELECT o_custkey, o_orderpriority AS split, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT o_custkey, split, CASE WHEN o_custkey % 50 = 1 THEN n + 1 ELSE n END AS n FROM a WHERE o_custkey % 70 <> 2)
    (SELECT *, 'first' AS side FROM a EXCEPT ALL SELECT *, 'first' FROM s) UNION ALL (SELECT *, 'second' FROM s EXCEPT ALL SELECT *, 'second' FROM a)"""
)
def manifest_audit(spark, sf_dir):
    """Counts by group and split, counted again, against those of a manifest that lacks some and has others wrong."""
    again = read(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("split")).agg(F.count("*").alias("n"))
    stored = again.where("o_custkey % 70 <> 2").withColumn("n", F.when(F.col("o_custkey") % 50 == 1, F.col("n") + 1).otherwise(F.col("n")))
    return E.set_difference(again, stored)


@query(
    f"""WITH x AS (SELECT embedding[1] AS s, abs(embedding[2]) * 3 AS iou FROM embeddings), t AS (SELECT t, avg(CASE WHEN abs(s) >= t THEN CAST(iou AS DOUBLE) ELSE 0 END) AS mean_iou, avg(CAST(abs(s) >= t AND iou >= 0.5 AS DOUBLE)) AS acc, count(*) FILTER (abs(s) < t) AS missing FROM x, (VALUES (CAST(0.0 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) v(t) GROUP BY t)
    SELECT t AS threshold, {_MICRO.format('mean_iou')} AS mean_iou, missing FROM t ORDER BY acc DESC, t.mean_iou DESC, missing, t DESC LIMIT 1"""
)
def chosen_threshold(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.abs(F.get("embedding", F.lit(0))).alias("s"), (F.abs(F.get("embedding", F.lit(1))) * 3).cast("double").alias("iou"))
    rows = e.select("s", "iou", F.explode(F.array(*map(F.lit, (0.0, 0.05, 0.1, 0.2)))).alias("threshold"))
    rows = rows.select("threshold", F.when(F.col("s") >= F.col("threshold"), F.col("iou")).alias("iou"), F.lit(False).alias("huge"))
    return M.choose_threshold(M.grounding_summary(rows, ["threshold"])).select("threshold", N.micro(F.col("mean_iou")).alias("mean_iou"), F.col("no_detection").alias("missing"))
