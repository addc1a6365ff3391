import hashlib
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import pipeline as corpus_pipeline
from rasterloom.llm import byte_bpe, decontaminate, pseudonyms, queries, quality_rules, simhash

from ..oracle import same
from .test_byte_bpe import RANKS, WHOLE
from .test_simhash import slow_print, slow_roots

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_simhash_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {r.doc_id: slow_print(r.text) for r in rows}
    roots = slow_roots(sorted(set(prints.values())))
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(roots[p], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", first[roots[p]]) for i, p in prints.items()}


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        after = {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count()
        if k < 4:
            assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in after.values())
        if name == "quality rules":
            kept = {r.doc_id for r in quality_rules.judge(docs).where("quality.kept").collect()}
            assert after.keys() == kept
        elif name == "near duplicates":
            # The rule of stages on word shingles: five words, a Jaccard of 0.8; classes are what such links connect.
            sets = {}
            for i, r in before.items():
                w = r.text.translate({c: c + 32 for c in range(65, 91)}).split()
                sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            root = {i: i for i in sets}
            for i in sorted(sets):
                for j in sorted(sets):
                    if i < j and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        a, b = sorted((root[i], root[j]))
                        root = {k: a if v == b else v for k, v in root.items()}
            assert after.keys() == set(root.values()) and len(after) < len(before) and all(after[i] == before[i] for i in after)
        elif name == "benchmark decontamination":
            found = decontaminate.annotate(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), out="c")
            bad = {r.doc_id for r in found.where(decontaminate.contaminated(F.col("c"))).collect()}
            assert after.keys() == before.keys() - bad
        elif name == "personal data":
            for i, r in after.items():
                for v in re.findall(r"[\w.]+@[\w.]+|\+\d \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|password=\w+", before[i].text):
                    luhn = not v.isdigit() or sum(d if j % 2 == 0 else 2 * d - 9 * (d > 4) for j, d in enumerate(int(c) for c in reversed(v))) % 10 == 0
                    assert not luhn or v not in r.text
        else:
            for i, r in after.items():
                ids = WHOLE.encode_ordinary(before[i].text)
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(before[i].text.encode()).hexdigest())
        if k < 4:
            out.write.parquet(path := str(tmp_path / str(k)))
            docs = spark.read.parquet(path)
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None, 7), (1, None, None, None, None, 7), (None, "", "en", "s", 0, 8), *[(k, " ".join(f"word{k // 3}x{j}" for j in range(40)), "en", None, 1, k) for k in range(9)]], "doc_id long, text string, lang string, source string, n_chars long, x long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        odd = stage(spark, odd, SF)
    assert sorted(r.doc_id for r in odd.collect()) == [0, 3, 6]
    assert len(after) > 50 and {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == after.keys()
    assert byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")) == RANKS and pseudonyms.ROUNDS == 8 and simhash.RADIUS == 2
