"""The queries opN_<name> of the text operators, and the SQL of those that SQL can express.

Each query applies its operator with production parameters to its whole table and derives the result's digest
columns from the operator's output.
"""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_events, cotrain, decontaminate, divergence, hard_negatives, hilbert_shards, maxent, pseudonyms, quality_rules, simhash, substrings, toxicity
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    x = F.col("contamination")
    return found.select(
        "doc_id",
        x["n_words"].alias("n_words"),
        x["n_hit"].alias("n_hit"),
        F.size(x["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(x["items"], ","), 256).alias("items_sha256"),
        decontaminate.contaminated(x).alias("contaminated"),
    )


OP1_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i+12], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, size, i, array_to_string(w[i:i+size-1], ' ') AS g
       FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT r, i, size, item_id FROM dw JOIN bw USING (size, g)),
n AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, size FROM hit), range(0, 13) AS o(k) WHERE k < size GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.assign(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, labels, fit_rows=third == 0, scale_rows=third == 2, out="score")
    return found.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def demonstration_key(spark: SparkSession) -> str:
    """The session's key, or for runs over synthetic tables one that everybody knows."""
    if found := spark.conf.get(pseudonyms.SETTING, None):
        return found
    warnings.warn(f"{pseudonyms.SETTING} is not set: pseudonyms under a public key can be undone by anyone", stacklevel=2)
    return "a key for synthetic data only"


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=demonstration_key(spark))
    changed = F.filter("findings", lambda x: x["changed"])
    return found.select("doc_id", "text", F.size("findings").cast("long").alias("n_found"), F.size(changed).cast("long").alias("n_changed"), F.array_join(F.transform(changed, lambda x: x["kind"]), ",").alias("kinds"))


def op5_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", *cotrain.METADATA), table(spark, sf_dir, "labels")
    found = cotrain.score(docs, labels, fit=third != 1, out="score")
    return found.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cotrain.KEEP).alias("kept"))


def op6_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    read = chat_events.read_back(chat_events.format_log(chat_events.as_events(rows)))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conversation").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
e AS (SELECT *, CAST(len(role) + len(regexp_replace(role, '[^\\<>\n]', '', 'g')) + len(text) + len(regexp_replace(text, '[^\\<]', '', 'g')) + 17 AS BIGINT) AS size FROM n)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    ranks = byte_bpe.read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep=False)
    decoded = byte_bpe.decode(coded, ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return maxent.score(docs, train=F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in names))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) >= 2),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM win JOIN twice USING (r, g), range(0, 5) AS o(k) GROUP BY r),
raw AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
norm AS (SELECT r, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM raw),
lines AS (SELECT r, host, t, line, len(string_split(line, ' ')) AS n FROM norm JOIN d USING (r) WHERE line <> ''),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
freq AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS c FROM lines GROUP BY host, line) JOIN hosts USING (host)
         WHERE c > 20 AND 1000 * c > 10 * docs),
lost AS (SELECT r, sum(n) AS n FROM lines SEMI JOIN freq USING (host, line) GROUP BY r),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.n, 0) AS lost
      FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (lost > 0 AND (n_words - lost < 10 OR 100 * lost > 50 * n_words)) AS kept
FROM g
"""

def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, own = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(own % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = e.select(own.alias("id"), label.alias("label"), hard_negatives.whole(F.col("embedding")).alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


OP11_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(coalesce(list_inner_product(a.v, b.v), 0) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i+49], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, i FROM win JOIN firsts USING (g) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, i + k AS i FROM hit, range(0, 50) AS o(k)),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
x AS (SELECT r, lang, source, unnest(t) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(own.total, 0) + 5 * size.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (size.total + 5 * size.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN size ON size.lang = g.lang
    LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_toxicity": op3_toxicity,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_cotrain": op5_cotrain,
    "op6_chat_events": op6_chat_events,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_maxent": op8_maxent,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substrings": op12_substrings,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL = {
    "op1_decontaminate": OP1_SQL,
    "op6_chat_events": OP6_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_substrings": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
