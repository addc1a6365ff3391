import zlib

import numpy as np

from rasterloom.llm import hilbert_shards as h


def test_curve_visits_neighbours():
    for bits, n in ((4, 2), (3, 3), (2, 4)):
        points = np.array(np.meshgrid(*[range(1 << bits)] * n, indexing="ij")).reshape(n, -1).T
        order = np.argsort(index := h.hilbert_index(points, bits))
        assert sorted(index.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_law_and_slots(spark):
    rows = [(i % 90 if i % 10 else None, None if i % 7 == 0 else "x" * i, f"l{i % 3}", "hot" if i % 3 else f"s{i}", i) for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = h.assign(df).collect()
    assert len(got) == 203
    by = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
    assert all(x == list(range(len(x))) for x in by) and max(map(len, by)) - min(map(len, by)) <= 1
    expect = sorted((len(r[1] or "") + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == expect
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_empty_and_few(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert h.assign(df).count() == 0
    df = spark.createDataFrame([(1, "a", "x", "y", 3)] * 3, df.schema)
    assert sorted((r.shard, r.slot) for r in h.assign(df).collect()) == [(0, 0), (2, 0), (5, 0)]


def test_shards_follow_the_curve(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in h.assign(docs).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    order = sorted(got, key=lambda i: (got[i].shard, got[i].slot))
    assert [got[i].curve for i in order] == sorted(got[i].curve for i in order)
    # Back from the curve to steps: each dimension's steps keep the order of its values, and equal values share one.
    cells = np.array(np.meshgrid(*[range(1 << h.BITS)] * 3, indexing="ij")).reshape(3, -1).T
    steps = dict(zip(h.hilbert_index(cells, h.BITS).tolist(), cells.tolist()))
    for d, name in enumerate(h.DIMENSIONS):
        pairs = sorted((getattr(rows[i], name), steps[got[i].curve][d]) for i in order)
        assert [s for _, s in pairs] == sorted(s for _, s in pairs)
        assert len({v: s for v, s in pairs}) == len(set(pairs)) and len({s for _, s in pairs}) > 1 + 2 * (name != "lang")
    # Files so prune by language: a shard holds fewer of them than the table does.
    shards = [{rows[i].lang for i in order if got[i].shard == k} for k in range(8)]
    assert sum(map(len, shards)) < 8 * len({r.lang for r in rows.values()})


def test_strings_with_one_beginning_differ(spark):
    df = spark.createDataFrame([(i, "x", "en", f"https://www.example.org/{i % 20:02d}", 5) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len({r.curve for r in h.assign(df).collect()}) >= 15


def test_equal_rows_are_dealt_over_many_ranges(spark):
    df = spark.createDataFrame([(None, "same", "en", "s", 4)] * 400, "doc_id long, text string, lang string, source string, n_chars long")
    got = h.assign(df).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(k, i) for k in range(8) for i in range(50)]


def test_written_files_hold_runs(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    h.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in docs.collect())
    want = {r.doc_id: r.shard for r in h.assign(docs).collect()}
    assert all(want[r.doc_id] == r.shard for r in back.collect())
