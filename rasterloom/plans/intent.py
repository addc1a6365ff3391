"""Bounded questions to intents: one ordered rule table, as a column expression and as a driver-side function."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARACTERS = 500


def _any(*terms: str) -> str:
    return r"\b(?:" + "|".join(terms) + r")\b"


# The patterns of a question's words (lower case).
INJECTION = (
    r"(?:ignore\s+(?:all\s+)?previous\s+instructions?|disregard\s+(?:the\s+)?system\s+prompt|jailbreak|developer\s+message|system\s+message"
    r"|(?:run|execute|invoke|call)\s+(?:a\s+)?(?:tool|function|command)|<\s*(?:system|developer|tool)\b)"
)
UNDERSCORES = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+){2,}\b"
NEGATION = _any(r"do\s+not", "don't", "dont", "never", "without", "avoid", "not")
BANK = _any("bank")
CHANGE = _any("change", "changed", "changes", "difference", "differ", "before", "after", "temporal", "between", "over time")
TIMES = _any("t1", "t2", "first", "second")
WATER = _any("water", "flood", "flooding", "wetland")
GAIN = _any("gain", "gained", "expand", "expanded", "increase", "increased", "appear", "appeared")
LOSS = _any("loss", "lost", "shrink", "shrunk", "decrease", "decreased", "disappear", "disappeared")
GROUND = _any("where", "locate", "location", "find", "map", "outline", "object", "region")
METADATA = _any("metadata", "crs", "projection", "resolution", "gsd", "sensor", "platform", "acquisition", "timestamp", "date", "bands", "polarization")
CAPABILITY = (
    r"\b(?:what|which|can|does)\b[^?\n]{0,80}\b(?:capabilit(?:y|ies)|support(?:ed)?|available|tools?|models?)\b"
    r"|\b(?:list|show)\b[^?\n]{0,40}\b(?:capabilit(?:y|ies)|tools?|models?)\b"
)
RADAR = _any("sar", "radar", "sentinel-1", "sentinel 1", "vv", "vh", "hh", "hv")
OPTICAL = _any("optical", "multispectral", "rgb", "sentinel-2", "sentinel 2")
WHAT_CHANGED = r"\bwhat\s+(?:has\s+)?changed\b"
DESCRIPTION = r"\b(?:describe|description|caption|summari[sz]e)\b.*\b(?:change|changed|difference|before|after)\b|" + WHAT_CHANGED
ASKING = _any("what", "which", "is", "are", "does", "do", "how", "identify", "tell", "answer")
AREA = _any("area", "hectares?", "ha", r"square\s+(?:meters?|metres?|kilometers?|kilometres?)", "m2", "km2")
INDICES = ("ndvi", "ndwi", "mndwi")
NOUNS = ("building", "road", "vehicle", "forest", "vegetation")
BACKWARDS = r"\b(?:t2|second|after|post)\b.{0,20}\b(?:to|vs|versus)\b.{0,20}\b(?:t1|first|before|pre)\b"
FORWARDS = r"\b(?:t1|first|before|pre)\b.{0,20}\b(?:to|vs|versus)\b.{0,20}\b(?:t2|second|after|post)\b"

# The names and the order of targets, measurements, directions and rules; results must equal them.
# A condition is a pattern, or ("and" | "or" | "not", conditions...). The first rule that holds gives its value.
TEMPORAL = ("or", CHANGE, GAIN, LOSS, TIMES)
BOTH = ("and", RADAR, OPTICAL)
INDEX = ("or", *(_any(i) for i in INDICES))
MEASURED = ("or", INDEX, AREA)
TARGET = [(BOTH, "sar"), (WATER, "water"), *((_any(i), i) for i in INDICES), (RADAR, "sar"), (OPTICAL, "optical"), *((_any(n, n + "s"), n) for n in NOUNS)]
MEASUREMENT = [*((_any(i), i) for i in INDICES), (AREA, "area")]
DIRECTION = [(("not", TEMPORAL), None), (BACKWARDS, "T2_TO_T1"), (FORWARDS, "T1_TO_T2"), (LOSS, "T2_TO_T1"), (GAIN, "T1_TO_T2")]
# (condition, rule, family)
RULES = [
    (("or", INJECTION, UNDERSCORES), "prompt_injection", "AMBIGUOUS"),
    (NEGATION, "negation", "AMBIGUOUS"),
    (BANK, "ambiguous_bank", "AMBIGUOUS"),
    (("and", MEASURED, ("or", DESCRIPTION, METADATA, CAPABILITY)), "conflicting_intents", "AMBIGUOUS"),
    *((_any(i), f"index_{i}", "MEASURE") for i in INDICES),
    (AREA, "area_measurement", "MEASURE"),
    (METADATA, "metadata_question", "METADATA_QUERY"),
    (BOTH, "optical_sar_comparison", "CROSS_MODAL_VQA"),
    (CAPABILITY, "capability_question", "CAPABILITY_QUERY"),
    (("and", TEMPORAL, DESCRIPTION, ("not", "^what\\s+(?:has\\s+)?changed\\b")), "change_description", "CHANGE_DESCRIPTION"),
    (("and", TEMPORAL, WATER, ("or", GAIN, LOSS)), "water_change_localization", "CHANGE_LOCALIZE"),
    (TEMPORAL, "temporal_change_question", "CHANGE_VQA"),
    (GROUND, "grounding_request", "GROUND_OBJECT"),
    (ASKING, "single_image_question", "SINGLE_VQA"),
]
SPATIAL = {"conflicting_intents", "area_measurement", *(f"index_{i}" for i in INDICES), "water_change_localization", "grounding_request"}
NO_TARGET = {"empty_query", "query_length_limit", "prompt_injection", "capability_question", "no_matching_rule"}
MEASURES = {"conflicting_intents", "area_measurement", *(f"index_{i}" for i in INDICES)}
DIRECTED = MEASURES | {"optical_sar_comparison", "change_description", "water_change_localization", "temporal_change_question"}


def _column(condition, text: Column) -> Column:
    if isinstance(condition, str):
        return text.rlike(condition)
    kind, *parts = condition
    found = [_column(p, text) for p in parts]
    out = ~found[0] if kind == "not" else found[0]
    for f in found[1:]:
        out = out & f if kind == "and" else out | f
    return out


def _holds(condition, text: str) -> bool:
    if isinstance(condition, str):
        return re.search(condition, text) is not None
    kind, *parts = condition
    return not _holds(parts[0], text) if kind == "not" else (all if kind == "and" else any)(_holds(p, text) for p in parts)


def _chain(rules, text: Column, last) -> Column:
    out = F.lit(last)
    for condition, value in reversed(rules):
        out = F.when(_column(condition, text), F.lit(value)).otherwise(out)
    return out


def interpret(query: Column, limit: int = MAX_CHARACTERS) -> Column:
    """struct(task_family, target_semantic, requested_measurement, temporal_direction, spatial_request, matched_rule).

    Lower case stands for compatibility folding, which agrees on ASCII; ``interpret_one`` folds other text too.
    """
    folded = F.trim(F.lower(F.coalesce(query, F.lit(""))))
    named = lambda rule, family: F.struct(F.lit(rule).alias("rule"), F.lit(family).alias("family"))

    def with_rule(text: Column) -> Column:
        first = named("no_matching_rule", "AMBIGUOUS")
        for condition, rule, family in reversed(RULES):
            first = F.when(_column(condition, text), named(rule, family)).otherwise(first)
        first = F.when(text == "", named("empty_query", "AMBIGUOUS")).when(F.length(text) > limit, named("query_length_limit", "AMBIGUOUS")).otherwise(first)
        return F.struct(text.alias("text"), first.alias("first"))

    def told(x: Column) -> Column:
        text, rule, family = x["text"], x["first"]["rule"], x["first"]["family"]
        spatial = rule.isin(*SPATIAL) | (rule.isin("ambiguous_bank", "temporal_change_question") & text.rlike(GROUND))
        return F.struct(
            F.when((family == "MEASURE") & _column(TEMPORAL, text), "CHANGE_MEASURE").otherwise(family).alias("task_family"),
            F.when(rule == "ambiguous_bank", "bank").when(rule == "water_change_localization", "water").when(~rule.isin(*NO_TARGET), _chain(TARGET, text, None)).alias("target_semantic"),
            F.when(rule.isin(*MEASURES), _chain(MEASUREMENT, text, None)).alias("requested_measurement"),
            F.when(rule.isin(*DIRECTED), _chain(DIRECTION, text, "UNKNOWN")).alias("temporal_direction"),
            spatial.alias("spatial_request"),
            rule.alias("matched_rule"),
        )

    # Bound by lambdas, so that folding and the rule chain are evaluated once, not wherever they are named.
    return F.element_at(F.transform(F.transform(F.array(folded), with_rule), told), 1)


def interpret_one(query: str, limit: int = MAX_CHARACTERS) -> dict:
    """The same for one question on the driver, after compatibility folding (NFKC) and case folding."""
    if not isinstance(query, str):
        raise TypeError("a question is text")
    text = unicodedata.normalize("NFKC", query).casefold().strip()
    first = lambda rules, last: next((v for c, v in rules if _holds(c, text)), last)
    rule = "empty_query" if not text else "query_length_limit" if len(text) > limit else first([(c, r) for c, r, _ in RULES], "no_matching_rule")
    family = {r: f for _, r, f in RULES}.get(rule, "AMBIGUOUS")
    if family == "MEASURE" and _holds(TEMPORAL, text):
        family = "CHANGE_MEASURE"
    return {
        "task_family": family,
        "target_semantic": "bank" if rule == "ambiguous_bank" else "water" if rule == "water_change_localization" else None if rule in NO_TARGET else first(TARGET, None),
        "requested_measurement": first(MEASUREMENT, None) if rule in MEASURES else None,
        "temporal_direction": first(DIRECTION, "UNKNOWN") if rule in DIRECTED else None,
        "spatial_request": rule in SPATIAL or (rule in ("ambiguous_bank", "temporal_change_question") and _holds(GROUND, text)),
        "matched_rule": rule,
    }


def required_capabilities(family: Column, target: Column, measurement: Column) -> Column:
    """array<string> of the capabilities that an intent calls for."""
    change = family.isin("CHANGE_VQA", "CHANGE_LOCALIZE", "CHANGE_MEASURE")
    one = lambda name: F.array(F.lit(name))
    radar = F.when(F.coalesce(measurement == "area", F.lit(False)), F.array(F.lit("deterministic_sar_temporal_change"), F.lit("mask_area_measurement"))).otherwise(one("deterministic_sar_temporal_change"))
    return (
        F.when(family == "SINGLE_VQA", one("single_image_vqa"))
        .when(family == "GROUND_OBJECT", one("text_guided_grounding"))
        .when(family == "CHANGE_DESCRIPTION", one("change_captioning"))
        .when(family == "CROSS_MODAL_VQA", one("multisensor_land_cover_joint"))
        .when(measurement.isin(*INDICES), F.array(F.concat(F.lit("spectral_index_"), measurement)))
        .when(change & (target == "sar"), radar)
        .when(change, one("temporal_difference"))
        .when(measurement == "area", one("mask_area_measurement"))
        .otherwise(F.array().cast("array<string>"))
    )
