"""Source divergence audit: how far the word use of a source is from the other sources of its language, and by which
terms it stands out. Relational throughout.

Terms are runs of letters (``TERM``; A-Z lower-cased). A language keeps the terms of at least ``MIN_DOCS`` of its
documents. Every group (lang, source) and every language gives each kept term the share
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), zeros included, N being the count of all kept terms and V their number.

Steps: each text's matches are exploded once, with a mark for a term's first match of the text, and counted by
(lang, source, term) before the shuffle; groups are crossed with their language's vocabulary; a self-join on language
and term sums |p - q| by pair of sources (each pair once, then mirrored); windows rank.

What moves: counts by (lang, source, term), to count them, for the vocabulary and to choose those of kept terms; the join
of pairs is summed before it is shuffled. The crossing is by language and a hash of the term in ``SALTS`` parts, so that a
language of most rows is spread. Shares are computed in decimals, so that counts beyond 9e9 are exact.

Defined results: null text, lang and source are ''; a text without terms still makes its group; repeated rows count as
documents of their own; a language without kept terms gives pairs of value 0 and no terms; a group alone in its
language has no pairs; ties go by item in UTF-8 order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, discard, written

#: Runs of letters: no ASCII character other than A-Z and a-z.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (matches), docs (documents with the term); a null term for each group, with its documents."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # The matches of TERM are what stands between the other characters; to split there takes a fifth of the time.
    terms = docs.select(text("lang").alias("lang"), text("source").alias("source"), F.array_remove(F.split(F.translate(text("text"), _UPPER, _LOWER), BETWEEN), "").alias("t"))
    # All matches, then each term once, then one null: what a row is, its place tells.
    each = terms.select("lang", "source", F.size("t").alias("all"), F.posexplode(F.concat("t", F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("at", "term"))
    once = F.col("term").isNotNull() & (F.col("at") >= F.col("all"))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") < F.col("all")).alias("n"), F.count_if(once).alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", (wide(n) + F.lit(SMOOTHING)) * F.lit(SCALE), wide(total) + wide(terms) * F.lit(SMOOTHING))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; ``docs`` has lang, source and text."""
    counts, path = written(term_counts(docs), "term_counts")
    groups = counts.where("term is null").select("lang", "source")
    vocabulary = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    vocabulary = cut_lineage(vocabulary.select("lang", "term", "all_n"))
    totals = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    kept = cut_lineage(counts.where("term is not null").select("lang", "source", "term", "n").join(vocabulary.select("lang", "term"), ["lang", "term"]))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # Groups with their figures, a copy for each part of the vocabulary.
    sized = groups.join(totals, "lang").join(own, ["lang", "source"], "left").select("lang", "source", "v", "all_total", F.coalesce("total", F.lit(0)).alias("total"))
    sized = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    crossed = vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(sized, ["lang", "salt"])
    dense = crossed.join(kept, ["lang", "source", "term"], "left").select(
        "lang",
        "source",
        "term",
        F.coalesce("n", F.lit(0)).alias("n"),
        _share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("v")).alias("p"),
        _share(F.col("all_n"), F.col("all_total"), F.col("v")).alias("q"),
    )
    dense, groups = cut_lineage(dense), cut_lineage(groups)
    discard(docs.sparkSession, path)
    other = dense.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"))
    pairs = dense.join(other, ["lang", "term"]).where(F.col("source") < F.col("other"))
    pairs = pairs.groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("p") - F.col("other_p"))).alias("value"))
    # Languages that keep no term.
    bare = groups.join(totals.select("lang"), "lang", "left_anti")
    empty = bare.join(bare.select("lang", F.col("source").alias("other")), "lang").where(F.col("source") < F.col("other")).select("lang", "source", "other", F.lit(0).cast("long").alias("value"))
    both = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.union(empty).select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")
    terms = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(pairs, "pair").union(_ranked(terms, "term").where(F.col("rank") <= top_terms))
