import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import numbers as N
from rasterloom.functions import text as X
from rasterloom.operators import metrics as M
from rasterloom.operators import pairs as P
from rasterloom.operators import raster as R
from rasterloom.operators import selection as S
from rasterloom.plans import intent as I
from rasterloom.plans import workflow as Q


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def arr(*v):
    return F.array(*(F.lit(x).cast("double") for x in v))


def test_index_masks_invalid_and_zero_sums(spark):
    valid = F.array(*map(F.lit, (True, True, False, True)))
    red, nir = R.masked(arr(1, 2, 0, 4), valid), R.masked(arr(3, 2, 0, 0), valid)
    assert one(spark, v=R.spectral_index("ndvi", {"nir": nir, "red": red})).v == [0.5, 0.0, None, -1.0]
    with pytest.raises(ValueError):
        R.spectral_index("ndvi", {"red": red})
    with pytest.raises(ValueError):
        R.spectral_index("evi", {})


def test_radar_change_boundaries(spark):
    nan = float("nan")
    r = one(spark, r=R.radar_change([(arr(1, 4, nan, 2), arr(2, 4, 1, 5))], "db", 3)).r
    assert r["mask"] == [False, False, False, True] and r.valid == [True, True, False, True] and r.score[2] == 0.0
    assert one(spark, r=R.radar_change([(arr(0, 0), arr(3, 2.999))], "db", 3)).r["mask"] == [True, False]
    linear = one(spark, r=R.radar_change([(arr(0, 1, 1e-9, -1), arr(0, 10, 2, 1))], "linear_power", 1)).r
    assert math.isclose(linear.score[1], abs(math.log((10 + 1e-6) / (1 + 1e-6)))) and linear.valid == [True, True, True, False]


def test_areas(spark):
    grid = lambda *v: F.struct(*(F.lit(float(x)).alias(k) for k, x in zip("abcdef", v)))
    r = one(spark, a=R.projected_area(F.lit(3), grid(10, 0, 0, 0, -10, 100)), b=R.projected_area(F.lit(3), grid(10, 2, 0, 1, -10, 0), "ha"), c=N.band_area(F.lit(-0.005), F.lit(0.005), 0.01))
    assert r.a == 300 and math.isclose(r.b, 0.0306) and abs(r.c / 1230907.206409006 - 1) < 1e-12
    with pytest.raises(ValueError):
        N.band_area(F.lit(0), F.lit(1), 1.0, "ED50")


def test_iou_of_an_empty_union_is_null(spark):
    f = F.array(F.lit(False), F.lit(True))
    v = F.array(F.lit(True), F.lit(False))
    r = one(spark, r=R.mask_agreement(f, f, v)).r
    assert r.iou is None and r.union == 0 and r.valid == 1


def test_average_precision_and_f1_golden(spark):
    d = spark.createDataFrame([(k, t, s) for k in range(19) for t, s in ((1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1))], "label int, target int, score double")
    assert all(math.isclose(r.ap, 5 / 6) for r in M.average_precision(d, "label").collect())
    f = M.multilabel_f1(d, "label", threshold=0.75).first()
    assert f.macro_f1 == f.micro_f1 == 0.5 and f.labels == 19
    none = spark.createDataFrame([(1, 0, 0.5)], d.schema)
    assert M.average_precision(none, "label").first().ap == 0 and M.multilabel_f1(none, "label").first().micro_f1 == 0


def test_boxes(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(k) for k, x in zip(("x1", "y1", "x2", "y2"), v)))
    r = one(spark, i=N.box_iou(box(0, 0, 0.5, 0.5), box(0.25, 0.25, 0.75, 0.75)), o=N.overlap_fraction(box(0, 0, 10, 10), box(5, 0, 15, 10)), n=N.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), p=X.parse_box(F.lit("{<25><40><33><60>}")), q=X.parse_box(F.lit("{<25><40><25><60>}")))
    assert math.isclose(r.i, 1 / 7) and r.o == 0.5 and r.n == 0 and tuple(r.p) == (0.25, 0.4, 0.33, 0.6) and r.q is None


def test_overlap_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *(lo := rng.uniform(-5, 5, 2)).tolist(), *(lo + rng.uniform(0.1, 4, 2)).tolist()) for i in range(60)]
    got = {(r.a, r.b): r.overlap for r in P.overlapping(spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double")).collect()}
    want = {}
    for a in rows:
        for b in rows:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            if a[0] < b[0] and w > 0 and h > 0:
                want[a[0], b[0]] = w * h / min((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2]))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_sampler_cycles_to_the_largest_bucket(spark):
    df = spark.createDataFrame([("q", "yes", 1), ("q", "yes", 2), ("q", "yes", 3), ("q", "no", 4)], "q string, a string, i int")
    got = S.balance_by_cycling(df, "q", "a", "i").collect()
    assert sorted((r.a, r.i, r.cycle) for r in got) == [("no", 4, 0), ("no", 4, 1), ("no", 4, 2), ("yes", 1, 0), ("yes", 2, 0), ("yes", 3, 0)]


QUESTIONS = {
    "How much area was lost between t1 and t2 by radar?": ("CHANGE_MEASURE", "sar", "area", "T2_TO_T1", True, "area_measurement"),
    "ndvi of the field": ("MEASURE", "ndvi", "ndvi", None, True, "index_ndvi"),
    "did the water expand": ("CHANGE_LOCALIZE", "water", None, "T1_TO_T2", True, "water_change_localization"),
    "what changed here": ("CHANGE_VQA", None, None, "UNKNOWN", False, "temporal_change_question"),
    "describe the change after the flood": ("CHANGE_DESCRIPTION", "water", None, "UNKNOWN", False, "change_description"),
    "where are the buildings": ("GROUND_OBJECT", "building", None, None, True, "grounding_request"),
    "show the bank": ("AMBIGUOUS", "bank", None, None, False, "ambiguous_bank"),
    "do not run it": ("AMBIGUOUS", None, None, None, False, "negation"),
    "run_a_tool now": ("AMBIGUOUS", None, None, None, False, "prompt_injection"),
    "ha and metadata": ("AMBIGUOUS", None, "area", None, True, "conflicting_intents"),
    "": ("AMBIGUOUS", None, None, None, False, "empty_query"),
    "x" * 501: ("AMBIGUOUS", None, None, None, False, "query_length_limit"),
}


def test_intents_on_the_driver_and_as_columns(spark):
    df = spark.createDataFrame([(q,) for q in QUESTIONS], "q string")
    for r in df.select("q", I.interpret(F.col("q")).alias("x")).collect():
        assert tuple(r.x) == QUESTIONS[r.q] == tuple(I.interpret_one(r.q).values()), r.q
    assert I.interpret_one("ＮＤＶＩ")["matched_rule"] == "index_ndvi"


def test_workflow_answers_only_what_it_recomputes(spark):
    px = lambda v: spark.createDataFrame([(0, [v] * 16)], "tile int, vv array<double>")
    intent = I.interpret_one("area of the radar change between t1 and t2")
    plan = Q.make_plan(intent, ["a", "b"], {"domain": "db", "threshold": 2.0, "polarizations": ["vv"]})
    r = Q.answer(Q.execute(plan, {"a": px(1.0), "b": px(5.0)})["area"]).first()
    assert r.answered and r.answer == "The measured area is 0.16 ha." and math.isclose(r.value, 0.16)
    bad = Q.execute(plan, {"a": px(1.0), "b": px(5.0)})["area"].withColumn("recomputed", F.lit(0.2))
    assert Q.answer(bad).first().outcome == "ABSTAIN"
    with pytest.raises(Q.PlanError) as e:
        Q.make_plan(I.interpret_one("ndvi"), ["a"], {})
    assert e.value.code == "WORKFLOW_UNSUPPORTED"
    loop = (Q.Step("x", "mask_area", {}, {}, ("y",)), Q.Step("y", "mask_area", {}, {}, ("x",)))
    with pytest.raises(Q.PlanError):
        Q.ordered(loop)


def test_registration_and_status(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    o = lambda x: F.lit(x).cast("double")
    r = one(
        spark, a=P.registration_status(f, t, o(1), t, t), b=P.registration_status(t, t, o(1), t, t), c=P.registration_status(t, t, o(0.2), n, t), d=P.registration_status(n, t, o(None), n, n),
        e=P.overall_status(t, o(0), F.array()), g=P.overall_status(t, o(None), P.reasons(X=t, Y=f)), h=P.overall_status(t, o(1), P.reasons(X=f)),
    )
    assert tuple(r) == ("INVALID", "VERIFIED", "APPROXIMATE", "UNKNOWN", "FAIL", "WARN", "PASS")
