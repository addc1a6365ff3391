"""Quality rules with cross-document line frequency, in DataFrame functions only.

A document is rejected by its own figures (too few words, too much of it repeated) or because too much of it
is lines that very many other documents of the same host carry too.

Line rule: lines are normalised (white-space runs become one space, ends trimmed, lower case) and hashed. For
each host the *distinct* documents (by text) with a line are counted, so that exact copies of one document count
once. A line is frequent in a host if it is in more than ``min_docs`` of its distinct documents and in more than
``max_permille`` thousandths of them: a small share, so that boilerplate of a tenth, or of a fiftieth, of a host is met
in every host, while lines that some dozens of near copies in a very large host share are left to near-duplicate removal. Frequent lines are removed; a document is depleted if fewer than
``min_words`` words remain, or if over ``max_removed_percent`` of its words went.

Plan: the only things shuffled are line hashes with word counts, once per distinct (host, text), their counts by
(host, line) after a partial count, and rows of figures; a frequent line in a third of all rows costs one
partially aggregated row per task. Texts are never shuffled for the figures.

Defined results: a null text is an empty one (no words, base_failed); a null host is the host ''. Equal rows are
judged each for itself, with the same verdict. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_RUN, fresh, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_DOCS = 20
MAX_PERMILLE = 10
MAX_REMOVED_PERCENT = 50


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(line, F.lit(SPACE_CHARS)), SPACE_RUN, " "))


def _line_structs(text: Column) -> Column:
    """(hash, words) of each distinct normalised line that has a word; a line's words count once for each copy of it."""
    normal = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal_line), lambda x: x != "")
    return F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def text_figures(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the struct ``out``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    w, h, s, m = (fresh(docs, f"_{out}_{k}") for k in ("w", "h", "s", "m"))
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size(w)
    df = docs.withColumn(w, words(F.col(text)))
    coded = F.transform(w, lambda x: F.xxhash64(x))
    df = df.withColumn(m, coded)
    # Windows by zipping the shifted codes: a lambda that slices the array would compute it anew for each window.
    shifted = F.arrays_zip(*(F.slice(m, F.lit(k + 1), n).alias(f"c{k}") for k in range(WINDOW)))
    windows = F.transform(F.slice(shifted, F.lit(1), n - (WINDOW - 1)), lambda x: F.xxhash64(*(x[f"c{k}"] for k in range(WINDOW))))
    df = df.withColumn(h, F.when(n >= WINDOW, windows))
    # Only texts with an equal pair of windows go on: windows sorted by hash, those equal to a neighbour, then their places in order.
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    hashes = F.transform(s, lambda x: x["h"])
    k = F.size(s)
    none = F.array(F.lit(None).cast("long"))
    before = F.concat(none, F.slice(hashes, F.lit(1), k - 1))
    after = F.concat(F.slice(hashes, F.lit(2), k - 1), none)
    twin = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    marked = F.zip_with(s, twin, lambda x, y: F.when((x["h"].eqNullSafe(y["a"]) | x["h"].eqNullSafe(y["b"])), x["i"]))
    places = F.sort_array(F.filter(marked, lambda x: x.isNotNull()))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).cast("long").alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    lines_in = fresh(docs, f"_{out}_l")
    df = df.withColumn(lines_in, lines)
    figures = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines_in) - F.size(F.array_distinct(lines_in))).cast("long").alias("n_dup_lines"),
        F.when(F.col(s).isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )
    # A generator of one row keeps a filter on the figures above them; pushed below, it would compute each of the
    # intermediate arrays again wherever it names them.
    return df.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode_outer(F.array(figures)).alias(out))


def base_failed(figures: Column) -> Column:
    n = figures["n_words"]
    return (n < MIN_WORDS) | (100 * figures["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def frequent_lines(docs: DataFrame, host: str, text: str, min_docs: int, max_permille: int) -> tuple[DataFrame, DataFrame]:
    """(lines of each distinct text: host, th, h, n) and (frequent lines: host, h)."""
    keyed = docs.select(
        F.coalesce(F.col(host), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
        _line_structs(F.col(text)).alias("lines"),
    )
    texts = keyed.groupBy("host", "th").agg(F.first("lines").alias("lines"))
    # Each distinct line of a text once for the counts, with the words of all its copies.
    lines = texts.select("host", "th", F.explode("lines").alias("x")).select("host", "th", "x.h", "x.n")
    distinct = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = distinct.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    hosts = texts.groupBy("host").agg(F.count("*").alias("host_docs"))
    frequent = counts.join(hosts, "host").where(1000 * F.col("docs") > max_permille * F.col("host_docs")).select("host", "h")
    return lines, frequent


def judge(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    out: str = "quality",
    min_docs: int = MIN_DOCS,
    max_permille: int = MAX_PERMILLE,
    max_removed_percent: int = MAX_REMOVED_PERCENT,
) -> DataFrame:
    """``docs`` with a struct ``out``: the figures, base_failed, removed_words, removed_lines (hashes) and kept."""
    out, key_host, key_text = fresh(docs, out), fresh(docs, "_q_host"), fresh(docs, "_q_text")
    lines, frequent = frequent_lines(docs, host, text, min_docs, max_permille)
    removed = (
        lines.join(frequent, ["host", "h"], "left_semi")
        .groupBy("host", "th")
        .agg(F.sum("n").alias("_q_removed"), F.collect_set("h").alias("_q_lines"))
        .withColumnsRenamed({"host": key_host, "th": key_text})
    )
    df = text_figures(docs, text, out).withColumns({key_host: F.coalesce(F.col(host), F.lit("")), key_text: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    # The smaller side has a row only for texts that lose a line.
    df = df.join(removed.select(key_host, key_text, F.struct("_q_removed", "_q_lines").alias(gone := fresh(docs, "_q_gone"))), [key_host, key_text], "left")
    figures = F.col(out)
    n, lost = figures["n_words"], F.coalesce(F.col(gone)["_q_removed"], F.lit(0))
    depleted = (lost > 0) & ((n - lost < MIN_WORDS) | (100 * lost > max_removed_percent * n))
    failed = base_failed(figures)
    verdict = F.struct(
        *(figures[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        lost.cast("long").alias("removed_words"),
        F.coalesce(F.col(gone)["_q_lines"], F.array().cast("array<bigint>")).alias("removed_lines"),
        (~failed & ~depleted).alias("kept"),
    )
    return df.withColumn(out, verdict).select(*(F.col(f"`{c}`") for c in docs.columns), out)


def clean(docs: DataFrame, host: str = "source", text: str = "text", n_chars: str = "n_chars", **limits) -> DataFrame:
    """The kept documents with their frequent lines taken out; the columns of ``docs``. n_chars follows the text."""
    out = fresh(docs, "_verdict")
    df = judge(docs, host, text, out, **limits).where(F.col(out)["kept"])
    gone = F.col(out)["removed_lines"]
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normal_line(x)))), "\n")
    df = df.withColumn(text, F.when(F.size(gone) > 0, left).otherwise(F.col(text)))
    if n_chars in df.columns:
        df = df.withColumn(n_chars, F.when(F.size(gone) > 0, F.length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))
