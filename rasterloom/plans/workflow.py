"""From an intent to a verified answer: policies, plans, execution over DataFrames, answers.

The driver holds a plan of at most eight steps; a step composes DataFrames, so that nothing runs before its result is
asked for, and the engine plans the whole chain at once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import raster as R

# How many steps a plan may have, and the two sentences of an answer.
MAX_STEPS = 8
MEASURED = "The measured area is "
ABSTAIN = "I cannot provide a verified answer because the evidence did not pass verification."


class PlanError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Step:
    step_id: str
    tool: str
    inputs: dict[str, str]
    parameters: dict = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...]

    @property
    def sha256(self) -> str:
        body = [[s.step_id, s.tool, s.inputs, s.parameters, list(s.depends_on)] for s in self.steps]
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def ordered(steps: tuple[Step, ...]) -> list[Step]:
    """Steps after what they depend on, ties by id; a cycle or an unknown step is an error."""
    left = {s.step_id: s for s in steps}
    if len(left) != len(steps) or len(steps) > MAX_STEPS:
        raise PlanError("PLAN_INVALID", "steps are repeated or too many")
    done: list[Step] = []
    while left:
        ready = sorted(k for k, s in left.items() if all(d not in left for d in s.depends_on))
        if not ready or any(d not in {s.step_id for s in steps} for s in left.values() for d in s.depends_on):
            raise PlanError("PLAN_INVALID", "steps form a cycle or name an unknown one")
        done.append(left.pop(ready[0]))
    return done


def make_plan(intent: dict, observations: list[str], parameters: dict, unit: str = "ha") -> Plan:
    """Only radar change, alone or with its area, is a workflow; all else is refused by code."""
    family, target, measure = intent["task_family"], intent["target_semantic"], intent["requested_measurement"]
    area = family == "CHANGE_MEASURE" and measure == "area"
    if target != "sar" or not (area or family == "CHANGE_LOCALIZE"):
        raise PlanError("WORKFLOW_UNSUPPORTED", f"no workflow for {family} of {target}")
    if len(observations) != 2:
        raise PlanError("MISSING_TEMPORAL_INPUTS", "a change needs two observations")
    if {"domain", "threshold", "polarizations"} - set(parameters):
        raise PlanError("MISSING_PARAMETER", "domain, threshold and polarizations are needed")
    change = Step("change", "radar_change", {"t1": observations[0], "t2": observations[1]}, parameters)
    return Plan((change, Step("area", "mask_area", {"mask": "change"}, {"unit": unit}, ("change",))) if area else (change,))


def radar_change(inputs: dict[str, DataFrame], parameters: dict) -> DataFrame:
    """Tiles (tile, <polarisation>...) of both times to (tile, score, valid, mask)."""
    pols = parameters["polarizations"]
    a, b = (inputs[t].select("tile", *(F.col(p).alias(f"{p}_{t}") for p in pols)) for t in ("t1", "t2"))
    change = R.radar_change([(F.col(f"{p}_t1"), F.col(f"{p}_t2")) for p in pols], parameters["domain"], parameters["threshold"])
    return a.join(b, "tile").select("tile", change.alias("r")).select("tile", "r.*")


def mask_area(inputs: dict[str, DataFrame], parameters: dict) -> DataFrame:
    """One row: value, unit, positive and valid cells, and the same area summed again from pixels, as a check."""
    cell, unit = parameters.get("cell_m2", 100.0), parameters["unit"]
    t = inputs["mask"].select(R.count_true(F.col("mask")).alias("p"), R.count_true(F.col("valid")).alias("v"), F.aggregate("mask", F.lit(0.0), lambda s, x: s + F.when(x, cell).otherwise(0.0)).alias("again"))
    each = N.AREA_UNITS[unit]
    return t.agg((F.coalesce(F.sum("p"), F.lit(0)) * cell / each).alias("value"), F.lit(unit).alias("unit"), F.coalesce(F.sum("p"), F.lit(0)).alias("positive_pixel_count"), F.coalesce(F.sum("v"), F.lit(0)).alias("valid_pixel_count"), (F.coalesce(F.sum("again"), F.lit(0.0)) / each).alias("recomputed"))


#: Tools by name: every plan step runs one of these and nothing else.
TOOLS: dict[str, Callable[[dict[str, DataFrame], dict], DataFrame]] = {"radar_change": radar_change, "mask_area": mask_area}


def execute(plan: Plan, observations: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Results by step; inputs are observations or earlier steps."""
    results: dict[str, DataFrame] = {}
    for s in ordered(plan.steps):
        if s.tool not in TOOLS:
            raise PlanError("UNKNOWN_TOOL", s.tool)
        results[s.step_id] = TOOLS[s.tool]({k: results.get(v, observations.get(v)) for k, v in s.inputs.items()}, s.parameters)
    return results


def answer(measured: DataFrame, digits: int = 2) -> DataFrame:
    """(answered, outcome, answer, value, unit): a number is told only where its recomputation agrees."""
    ok = N.is_close(F.col("value"), F.col("recomputed"), 1e-9, 1e-9) & (F.col("positive_pixel_count") <= F.col("valid_pixel_count"))
    text = F.concat(F.lit(MEASURED), F.format_string(f"%.{digits}f", "value"), F.lit(" "), F.col("unit"), F.lit("."))
    return measured.select(ok.alias("answered"), F.when(ok, "ALLOW").otherwise("ABSTAIN").alias("outcome"), F.when(ok, text).otherwise(ABSTAIN).alias("answer"), F.when(ok, F.col("value")).alias("value"), "unit")


def step_key(step: Step, versions: dict[str, str]) -> str:
    """Cache key of a step: tool, inputs, parameters and versions in canonical form."""
    return hashlib.sha256(json.dumps([step.tool, step.inputs, step.parameters, versions], sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()
