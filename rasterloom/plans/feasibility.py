"""Whether an intent can be carried out with what is there: nine checks as columns, all of them always told.

Each check is a row of a table (name, whether it fails, outcome, code); the worst outcome of those that fail counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import records as C
from .intent import required_capabilities

# Outcomes from best to worst, families that need two times, those that compare cells, states that can run.
OUTCOMES = ("ALLOW", "ALLOW_WITH_WARNING", "ABSTAIN", "REQUEST_INPUT", "REJECT")
TEMPORAL = ("CHANGE_VQA", "CHANGE_LOCALIZE", "CHANGE_MEASURE", "CHANGE_DESCRIPTION", "CROSS_MODAL_VQA")
PIXELWISE = ("MEASURE", "CHANGE_MEASURE", "CHANGE_LOCALIZE")
AVAILABLE = ("AVAILABLE", "AVAILABLE_WITH_LIMITS")
# Bands that an index needs.
INDEX_BANDS = {"ndvi": ("RED", "NIR"), "ndwi": ("GREEN", "NIR"), "mndwi": ("GREEN", "SWIR1")}


def _without(roles: tuple[str, ...], observations: Column) -> Column:
    """Whether an observation lacks one of the roles."""
    return F.exists(observations, lambda o: F.size(C.missing_bands(roles, o["descriptions"])) > 0)


def feasibility(intent: Column, observations: Column, pair: Column, capabilities: Column) -> Column:
    """struct(outcome, checks, allowed): the worst outcome, each check's name, passed, outcome and code, and what may run.

    intent: struct with task_family, target_semantic and requested_measurement; observations: array of struct(descriptions,
    crs, kind, polarizations, domain, sensor, jpeg); pair: struct(order_known, overlap_known, sufficient, aligned), null
    without one; capabilities: array of struct(id, status). Unknown alignment fails, unknown overlap does not."""
    family, target, asked = intent["task_family"], intent["target_semantic"], F.coalesce(intent["requested_measurement"], F.lit(""))
    temporal, paired, some = family.isin(*TEMPORAL), pair.isNotNull(), F.size(observations) > 0
    true = lambda c: F.coalesce(c, F.lit(False))
    unmet = F.lit(False)
    for index, roles in INDEX_BANDS.items():
        unmet = F.when(asked == index, _without(roles, observations)).otherwise(unmet)
    radar = true(target == "sar") | (family == "CROSS_MODAL_VQA")
    unclear = F.exists(observations, lambda o: true(C.radar_semantics_unknown(o["kind"], o["polarizations"], o["domain"], o["sensor"])))
    need = required_capabilities(family, target, intent["requested_measurement"])
    runs = F.transform(F.filter(capabilities, lambda c: c["status"].isin(*AVAILABLE)), lambda c: c["id"])
    rules = (
        ("temporal_pair", temporal & ~((F.size(observations) >= 2) & paired), "REQUEST_INPUT", "MISSING_TEMPORAL_PAIR"),
        ("temporal_order", temporal & paired & ~true(pair["order_known"]), "REQUEST_INPUT", "TEMPORAL_ORDER_UNKNOWN"),
        ("spatial_overlap", temporal & paired & true(pair["overlap_known"]) & true(~pair["sufficient"]), "REJECT", "NO_SPATIAL_OVERLAP"),
        ("pixel_grid", family.isin(*PIXELWISE) & paired & ~true(pair["aligned"]), "REJECT", "PAIR_ALIGNMENT_INVALID"),
        ("required_bands", some & unmet, "REJECT", "MISSING_REQUIRED_BAND"),
        ("measurement_crs", (asked == "area") & some & F.exists(observations, lambda o: o["crs"].isNull()), "REJECT", "CRS_REQUIRED_FOR_MEASUREMENT"),
        ("sar_semantics", radar & unclear, "REQUEST_INPUT", "UNKNOWN_SAR_POLARIZATION"),
        ("image_quality", (family == "SINGLE_VQA") & F.exists(observations, lambda o: true(o["jpeg"])), "ALLOW_WITH_WARNING", "GEOREFERENCE_UNAVAILABLE"),
        ("capabilities", F.size(F.array_except(need, runs)) > 0, "ABSTAIN", "MODEL_UNAVAILABLE"),
    )
    row = lambda name, fails, outcome, code: F.struct(F.lit(name).alias("name"), (~fails).alias("passed"), F.when(fails, outcome).otherwise(OUTCOMES[0]).alias("outcome"), F.when(fails, code).alias("code"))
    rank = lambda x: F.array_position(F.array(*map(F.lit, OUTCOMES)), x["outcome"])
    allowed = F.filter(runs, lambda c: (F.size(need) == 0) | F.array_contains(need, c))
    # Bound once, so that the checks are computed once however often they are named.
    told = lambda checks: F.struct(F.get(F.array(*map(F.lit, OUTCOMES)), (F.array_max(F.transform(checks, rank)) - 1).cast("int")).alias("outcome"), checks.alias("checks"), allowed.alias("allowed"))
    return F.element_at(F.transform(F.array(F.array(*(row(*r) for r in rules))), told), 1)
