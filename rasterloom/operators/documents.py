"""JSON documents of any depth as rows of their nodes: keys to strip, inputs to refuse, vertices to count.

Spark has no recursion in expressions, so a document is opened level by level: each level is one explode of the
containers of the level before, as VARIANT values, in as many rounds as the deepest document is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage

# Keys that an input must not have, at any depth, and keys that lead to vertices.
UNSAFE_KEYS = ("path", "url", "uri", "model", "model_id", "checkpoint", "implementation", "executor")
VERTEX_KEYS = ("coordinates", "geometry")
FREE_TEXT = "query"
#: Deeper documents are refused.
DEEPEST = 64


def _kind(v: Column) -> Column:
    """object, array, number, string or other."""
    k = F.schema_of_variant(v)
    number = k.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array").when(number, "number").when(k == "STRING", "string").otherwise("other")


def nodes(docs: DataFrame, key: str, json: str) -> list[DataFrame]:
    """The levels of the documents' nodes: ``key``, parent, place (paths of positions), name (of an object's field, else null), kind, text (JSON), value.

    A document that is no JSON has no nodes."""
    root = docs.select(key, F.try_parse_json(json).alias("value")).where("value is not null")
    level = root.select(key, F.lit(None).cast("string").alias("parent"), F.lit("$").alias("place"), F.lit(None).cast("string").alias("name"), _kind(F.col("value")).alias("kind"), F.to_json("value").alias("text"), "value")
    levels = []
    while True:
        level = cut_lineage(level)
        levels.append(level)
        inside = level.where("kind in ('object', 'array')")
        if inside.isEmpty():
            return levels
        if len(levels) > DEEPEST:
            raise ValueError(f"a document is deeper than {DEEPEST} levels")
        opened = inside.alias("d").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("d.value").outer()).alias("x")).select(F.col(f"d.{key}").alias(key), F.col("d.place").alias("parent"), F.concat_ws(".", F.col("d.place"), F.lpad(F.col("x.pos").cast("string"), 9, "0")).alias("place"), F.col("x.key").alias("name"), F.col("x.value").alias("value"))
        level = opened.select(key, "parent", "place", "name", _kind(F.col("value")).alias("kind"), F.to_json("value").alias("text"), "value")


def stripped(docs: DataFrame, key: str, json: str, *names: str) -> DataFrame:
    """(``key``, ``json``): the documents without the fields ``names``, at any depth; null where there is no JSON.

    Levels are closed from the deepest to the root: each container's text is made of those of the fields that stay."""
    levels = nodes(docs, key, json)
    closed = None
    for level in reversed(levels):
        rows = level.drop("value")
        if closed is not None:
            kept = closed.where(F.col("name").isNull() | ~F.col("name").isin(*names)) if names else closed
            # {"n":"name"} holds the name as JSON writes it.
            field = F.when(F.col("name").isNull(), F.col("text")).otherwise(F.concat(F.regexp_extract(F.to_json(F.struct(F.col("name").alias("n"))), r'(?s)^\{"n":(.*)\}$', 1), F.lit(":"), F.col("text")))
            body = kept.groupBy(key, F.col("parent").alias("place")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", field.alias("f")))), lambda x: x["f"]), ",").alias("_body"))
            rows = rows.join(body, [key, "place"], "left")
            inside = F.coalesce("_body", F.lit(""))
            rows = rows.withColumn("text", F.when(F.col("kind") == "object", F.concat(F.lit("{"), inside, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(F.col("text"))).drop("_body")
        closed = cut_lineage(rows)
    return docs.select(key).join(closed.select(key, F.col("text").alias(json)), key, "left")


def input_checks(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(``key``, unsafe, vertices): whether a document has a key of ``UNSAFE_KEYS`` (in any case) or, but for the free
    text, a value that is an absolute path or a file or web address; and how many vertices its geometry has: arrays that
    begin a run of two or more numbers and nothing else, reached through arrays and the keys ``VERTEX_KEYS`` only.
    Null for both where there is no JSON."""
    levels, reach, told = nodes(docs, key, json), None, None
    for level in levels:
        named = F.coalesce(F.lower("name").isin(*UNSAFE_KEYS), F.lit(False))
        text = F.when(F.col("kind") == "string", F.try_variant_get("value", "$", "string"))
        place = text.rlike(r"^[/\\]") | text.rlike(r"(?i)^[\x00-\x20]*(file|https?):")
        unsafe = named | (F.coalesce(place, F.lit(False)) & (F.col("name").isNull() | (F.col("name") != FREE_TEXT)))
        items = F.try_variant_get("value", "$", "array<variant>")
        vertex = (F.col("kind") == "array") & (F.size(items) >= 2) & F.forall(items, lambda v: _kind(v) == "number")
        rows = level.withColumn("_vertex", F.coalesce(vertex, F.lit(False)))
        if reach is None:
            rows = rows.withColumn("_reached", F.lit(True))
        else:
            up = reach.select(F.col(key).alias("_k"), F.col("place").alias("_p"), F.lit(True).alias("_up"))
            rows = rows.join(up, (F.col(key) == F.col("_k")) & (F.col("parent") == F.col("_p")), "left").withColumn("_reached", F.coalesce(F.col("_up") & (F.col("name").isNull() | F.col("name").isin(*VERTEX_KEYS)), F.lit(False)))
        rows = cut_lineage(rows.select(key, "place", unsafe.alias("_unsafe"), "_vertex", "_reached"))
        reach = rows.where("_reached and not _vertex")
        told = rows if told is None else told.union(rows)
    found = told.groupBy(key).agg(F.bool_or("_unsafe").alias("unsafe"), F.count_if(F.col("_reached") & F.col("_vertex")).alias("vertices"))
    return docs.select(key).join(found, key, "left")
