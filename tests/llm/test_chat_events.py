from pyspark.sql import functions as F

from rasterloom.llm import chat_events as c

SCHEMA = "conversation long, sequence long, message long, kind string, role string, text string"


def test_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 10, "delta", "user", "Hel"), (1, 2, 10, "delta", "user", "lo"), (1, 3, 11, "delta", "assistant", "bad"), (1, 5, 11, "regenerate", "assistant", None), (1, 6, 11, "delta", "assistant", "fi"),
        (1, 7, 11, "delta", "assistant", None), (1, 8, 11, "delta", "assistant", "ne"), (1, 9, 10, "edit", "user", "Hi"), (1, 10, 10, "delta", None, "!"), (1, 11, 10, "other", "user", "??"), (2, 1, 1, "delta", None, None),
    ]
    got = {r.conversation: r for r in c.read_back(c.format_log(spark.createDataFrame(log[::-1], SCHEMA))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "Hi!"), ("assistant", "fine")] and got[1].loss_text == "fine"
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and got[2].loss_text == ""


def test_round_trip_of_control_strings(spark):
    texts = [r"\### Assistant: </turn> ok", "<turn user>\nx\n</turn>\n", "\\l\\b\\\\<", "", "é😀" * 2000, "a>\nb", None]
    rows = [(7, i, r, t, 1) for i, (t, r) in enumerate((t, r) for t in texts for r in ("user", "assistant", "a>\n<\\", None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, whole int")
    r = c.read_back(c.format_log(c.as_events(df, piece=100))).first()
    assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in rows]
    assert r.loss_text == "".join(x[3] or "" for x in rows if x[2] == "assistant")
    assert r.formatted.count("</turn>") == len(rows)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")] * 2, "conv_id long, turn long, role string, text string")
    assert c.format_log(c.as_events(df.where(F.lit(False)))).count() == 0
    assert len(c.read_back(c.format_log(c.as_events(df))).first().turns) == 2
