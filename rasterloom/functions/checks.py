"""Checks of inputs as column functions: limits, ids, masks, detections, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_limits(limits: dict[str, tuple[Column, int]]) -> Column:
    """Names of the limits (name: value, most) that a value passes or that are unknown; none means that all hold."""
    over = [F.when(value.isNull() | (value > most), F.lit(name)) for name, (value, most) in limits.items()]
    return F.filter(F.array(*over), lambda x: x.isNotNull())


def plain_id(x: Column, fewest: int = 16, longest: int = 128) -> Column:
    """A key that a client may choose: letters, digits, dot, underscore and hyphen only, within a length; false for null."""
    return F.coalesce(x.rlike(rf"\A[A-Za-z0-9._-]{{{fewest},{longest}}}\z"), F.lit(False))


def binary_mask(mask: Column) -> Column:
    """Whether a mask holds 0, 1 and masked cells only."""
    return F.forall(mask, lambda v: v.isNull() | v.isin(0.0, 1.0))


def usable_detection(score: Column, phrase: Column, box: Column, width: Column, height: Column) -> Column:
    """Whether a detection has a phrase that is not blank, a score within 0 and 1, finite corners, and an area within the image."""
    finite = lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))
    ok = F.coalesce(score.between(0.0, 1.0) & ~F.isnan(score), F.lit(False)) & F.coalesce(phrase.rlike(r"\S"), F.lit(False))
    for k in ("x1", "y1", "x2", "y2"):
        ok = ok & finite(box[k])
    inside = (F.least(box["x2"], width) > F.greatest(box["x1"], F.lit(0.0))) & (F.least(box["y2"], height) > F.greatest(box["y1"], F.lit(0.0)))
    return ok & F.coalesce(inside, F.lit(False))


def strict_zip(a: Column, b: Column) -> Column:
    """Pairs of two arrays of one length; null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b")))


def guardrail(final: Column, first: Column, chosen: Column) -> Column:
    """A last policy against two earlier ones; each a struct with mean_iou and acc_50.

    Accepted where both metrics are strictly better than the chosen policy's; the deltas to both policies are told."""
    delta = lambda other, k: (final[k] - other[k]).alias(k)
    told = lambda other: F.struct(delta(other, "mean_iou"), delta(other, "acc_50"))
    accepted = (final["mean_iou"] > chosen["mean_iou"]) & (final["acc_50"] > chosen["acc_50"])
    return F.struct(F.coalesce(accepted, F.lit(False)).alias("accepted"), told(first).alias("to_first"), told(chosen).alias("to_chosen"))


def reproduced(counts: dict[str, tuple[Column, Column]], metrics: dict[str, tuple[Column, Column]], tolerance: float = 1e-4) -> Column:
    """Names of the figures (name: found, anchor) that a repeated run does not reproduce: counts exactly, metrics within a tolerance."""
    odd = [F.when(~a.eqNullSafe(b), F.lit(k)) for k, (a, b) in counts.items()]
    odd += [F.when(F.coalesce(F.abs(a - b) > tolerance, F.lit(True)), F.lit(k)) for k, (a, b) in metrics.items()]
    return F.filter(F.array(*odd), lambda x: x.isNotNull())


def member_refusal(name: Column, kind: Column) -> Column:
    """Why a member of an archive (its name, and its kind: file, dir or another) may not be unpacked; null if it may."""
    parts = F.filter(F.split(name, "/"), lambda p: (p != "") & (p != "."))
    path = name.startswith("/") | (F.size(parts) == 0) | F.get(parts, F.lit(0)).endswith(":") | F.array_contains(parts, "..")
    return (
        F.when(name.isNull() | F.contains(name, F.lit("\0")) | F.contains(name, F.lit("\\")), "separator")
        .when(path, "path")
        .when(~F.coalesce(kind.isin("file", "dir"), F.lit(False)), "kind")
    )


def copy_fault(written: Column, declared: Column) -> Column:
    """Why a copied member is no exact copy; null if its size is the declared one."""
    return F.when(written > declared, "exceeds declared size").when(~written.eqNullSafe(declared), "size mismatch")


#: What a completion marker must agree in.
MARKER_FIELDS = ("manifest_sha256", "modality", "archive_md5", "compressed_bytes_streamed", "selected_members")


def marker_outcome(marker: Column, required: Column) -> Column:
    """REUSE where all fields of a completion marker (JSON) equal the required ones (a struct), INVALID where it is no object, else MISMATCH."""
    parsed = F.try_parse_json(marker)
    kind = F.schema_of_variant(parsed)
    field = lambda k: F.try_variant_get(parsed, f"$.{k}", "string")
    same = [field(k).eqNullSafe(required[k].cast("string")) for k in MARKER_FIELDS]
    every = same[0]
    for x in same[1:]:
        every = every & x
    return F.when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "INVALID").when(every, "REUSE").otherwise("MISMATCH")


def validation_details(errors: Column, most: int = 20) -> Column:
    """The first errors (struct: loc, an array; type; and what must not be told) as struct(field, category)."""
    return F.transform(F.slice(errors, 1, most), lambda e: F.struct(F.array_join(e["loc"], ".").alias("field"), e["type"].alias("category")))


def matching(df: DataFrame, asked: dict) -> DataFrame:
    """Rows that equal all given values; fields that are None do not count. Fields that are not there are an error."""
    if unknown := sorted(k for k, v in asked.items() if v is not None and k not in df.columns):
        raise ValueError(f"unknown fields {unknown}")
    for k, v in asked.items():
        if v is not None:
            df = df.where(F.col(k) == F.lit(v))
    return df
