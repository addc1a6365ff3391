"""Text column functions: normal forms, question types, boxes written as text, canonical hashes, cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(x: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, trimmed (ß counts as ss, as in case folding)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "ß", "ss"), "[^a-z0-9]+", " "))


def question_type(question: Column) -> Column:
    q = normalize_text(question)
    return (
        F.when(q.contains("rural or an urban"), "rural_urban")
        .when(q.startswith("how many ") | q.startswith("what is the amount ") | q.startswith("what is the number "), "count")
        .when(q.startswith("are there more ") | q.startswith("are there less ") | (q.startswith("is the number ") & q.contains(" equal to ")), "comparison")
        .when(q.startswith("is there ") | q.contains(" present"), "presence")
        .otherwise("other")
    )


def parse_box(x: Column) -> Column:
    """struct(x1, y1, x2, y2) in 0..1 from {<a><b><c><d>}; null unless there are four whole numbers of 0..100 in order."""
    n = F.transform(F.regexp_extract_all(x, F.lit("<([0-9]+)>"), F.lit(1)), lambda v: v.cast("int"))
    ok = x.rlike("^[{](?:<[0-9]{1,3}>){4}[}]$") & (F.array_max(n) <= 100) & (F.get(n, F.lit(0)) < F.get(n, F.lit(2))) & (F.get(n, F.lit(1)) < F.get(n, F.lit(3)))
    return F.when(ok, F.struct(*((F.get(n, F.lit(i)) / 100.0).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2")))))


def phrase_matches_class(phrase: Column, name: Column) -> Column:
    """All words of the class name are words of the phrase, and there is one."""
    tokens = lambda c: F.filter(F.split(normalize_text(c), " "), lambda w: w != "")
    return (F.size(tokens(name)) > 0) & (F.size(F.array_except(tokens(name), tokens(phrase))) == 0)


def query_phrase(x: Column) -> Column:
    """Lower case, white space collapsed, one full stop at the end."""
    return F.concat(F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), "[.]+$", "")), F.lit("."))


def group_id(patch: Column) -> Column:
    """Grid cell at the end of a patch name, _Tnn AAA_h_v, joined by _; null if there is none."""
    part = lambda i: F.regexp_extract(patch, r"_(T\d{2}[A-Z]{3})_(\d+)_(\d+)$", i)
    return F.when(part(1) != "", F.concat_ws("_", part(1), part(2), part(3)))


def polarizations(tag: Column) -> Column:
    return F.filter(F.split(F.upper(tag), r"[,;/\s]+"), lambda v: v != "")


def acquisition_time(tag: Column) -> Column:
    """A timestamp from ISO text with an offset; null for naive or other text."""
    return F.when(tag.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(tag))


def fixed_width_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def cursor(ts: Column, key: Column) -> Column:
    """URL-safe base 64, without padding, of a page's last (time, key)."""
    body = F.base64(F.to_json(F.struct(fixed_width_time(ts).alias("t"), key.alias("k"))).cast("binary"))
    return F.rtrim(F.translate(body, "+/", "-_"), F.lit("="))


def tie_hash(seed: str, *parts: Column) -> Column:
    """SHA-256 of the seed and the parts, separated by NUL: an order that any engine reproduces."""
    pieces = [F.lit(seed)]
    for p in parts:
        pieces += [F.char(F.lit(0)), p]
    return F.sha2(F.concat(*pieces), 256)


def sample_id(patch: Column, other: Column) -> Column:
    return F.concat(F.lit("pair_"), F.substring(F.sha2(F.concat(patch, F.char(F.lit(0)), other), 256), 1, 24))


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x
