import hashlib
import pytest
import re

from rasterloom.llm import pseudonyms as p


def luhn(s):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(re.sub(r"\D", "", s)))) % 10 == 0


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r for r in sorted(p.pseudonymise(df, key="k", **kw).collect(), key=lambda r: r.doc_id)]


VALUES = [
    "4041894974608795", "4041 8949 7460 8795", "58.31.209.216", "+1 (626) 555-5759", "2024-02-29", "1987/12/31", "31/12/1999", "12/31/1999", "24.12.2031",
    "123-45-6789", "oeki.12@mail5.example.com", "password=b7db7aa4a5fcc78305", 'token = "0641917ea4e9feb9c83477b57ac2"', "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432",
]


def test_formats_links_and_inverse(spark):
    texts = [f"a {v} b." for v in VALUES] + [f"{v}" for v in VALUES]
    got = run(spark, texts)
    n = len(VALUES)
    for i, v in enumerate(VALUES):
        new = got[n + i].text
        assert new != v and got[i].text == f"a {new} b.", (v, new, got[i].text)
        kind = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", v)))
        assert i == 2 or re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", new))) == kind  # an address's numbers differ in length
    assert luhn(got[n].text) and re.sub(" ", "", got[n + 1].text) == got[n].text and got[n].text[0] == "4"
    assert all(int(x) < 256 for x in got[n + 2].text.split("."))
    assert got[n + 3].text.startswith("+1 (") and got[n + 4].text.startswith("20") and got[n + 5].text[:2] == "19"
    assert got[n + 10].text.endswith("@mail5.example.com")
    back = run(spark, [r.text for r in got], inverse=True)
    assert [r.text for r in back] == texts


def test_leaves_what_is_not_valid(spark):
    texts = ["4041894974608796", "999.1.1.1", "2024-02-30", "000-12-3456", "4586479", "version 1.2", "DE00370400440532013000", "plain words", "", None, "12345678901234567890123"]
    assert [r.text for r in run(spark, texts)] == texts


def test_bijective(spark):
    df = spark.range(35 * 40).selectExpr("id div 40 as l", "id % 40 as r")
    from pyspark.sql import functions as F

    out = df.select(p.permute_numbers(F.col("l"), F.col("r"), F.lit(35), F.lit(40), "k", "t").alias("x")).select("x.l", "x.r").distinct()
    assert out.count() == 1400 and out.where("l < 0 or l > 34 or r < 0 or r > 39").count() == 0


def test_several_in_a_text_and_extra_columns(spark):
    df = spark.createDataFrame([("x", "call +1 (626) 555-5759 or 58.31.209.216. And 58.31.209.216", 1, 2)], "findings string, text string, _fp_hits int, _fp_new int")
    r = p.pseudonymise(df, key="k").first()
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", r.text)
    assert ips[0] == ips[1] != "58.31.209.216" and r.findings == "x" and [f.kind for f in r._findings] == ["phone", "ip", "ip"]


def test_empty_table(spark):
    assert p.pseudonymise(spark.createDataFrame([], "text string"), key="k").count() == 0


def test_no_key_is_an_error_and_keys_stay_out_of_plans(spark, capsys):
    df = spark.createDataFrame([("call +1 (212) 555-0123",)], "text string")
    if not spark.conf.get(p.SETTING, None):
        with pytest.raises(ValueError):
            p.pseudonymise(df)
    p.pseudonymise(df, key="very secret").explain("formatted")
    shown = capsys.readouterr().out
    assert "very secret" not in shown and hashlib.sha256(b"very secret").hexdigest() not in shown and "text" in shown
