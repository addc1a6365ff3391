"""Very long texts, lines and conversations, and events of one sequence."""

import random
from collections import Counter

from rasterloom.llm import chat_events, quality_rules, simhash

from .test_simhash import slow_print


def _repeated(w):
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})


def test_figures_of_long_lines_and_many_lines(spark):
    rnd = random.Random(7)
    line = " ".join(f"w{rnd.randrange(30)}" for _ in range(20_000))
    lines = "\n".join(f"a{rnd.randrange(9_000)} b" for _ in range(12_000))
    df = spark.createDataFrame([(0, line), (1, lines), (2, "x" * 300_000), (1, lines)], "doc_id long, text string")
    got = quality_rules.text_figures(df, "text", "f").collect()
    assert len(got) == 4
    for r in got:
        w, split = r.text.split(), r.text.split("\n")
        assert (r.f.n_words, r.f.word_chars, r.f.n_dup_lines, r.f.n_repeat_words) == (len(w), sum(map(len, w)), len(split) - len(set(split)), _repeated(w))


def test_fingerprint_of_a_long_text():
    rnd = random.Random(3)
    text = " ".join(f"Tok{rnd.randrange(5_000)}" for _ in range(60_000))
    assert simhash.fingerprint(text.encode()) == slow_print(text)
    assert simhash.fingerprint(b"y" * 500_000) == slow_print("y" * 500_000)


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"</turn> {i}") for i in range(5_000)] + [(2, 0, "user", "long " * 60_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in chat_events.read_back(chat_events.format_log(chat_events.as_events(df))).withColumnRenamed("conversation", "conv").collect()}
    assert [t.text for t in got[1].turns] == [x[3] for x in rows[:-1]] and got[1].loss_text == "".join(x[3] for x in rows[:-1] if x[2] == "assistant")
    assert got[2].turns[0].text == rows[-1][3]


def test_events_of_one_sequence_are_taken_by_kind(spark):
    log = [(1, 1, 1, "edit", "user", "new"), (1, 1, 1, "delta", "user", "old"), (1, 2, 1, "delta", "user", "b"), (1, 2, 1, "delta", "user", "a")]
    for rows in (log, log[::-1]):
        df = spark.createDataFrame(rows, "conversation long, sequence long, message long, kind string, role string, text string")
        assert chat_events.fold(df).first().text == "newab"
