"""Cards inside runs of digits of any length: none stays, and the inverse is exact."""

import random
import re

from .test_pseudonyms import luhn, run

CARDS = ("4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "4111111111111111", "6304 0000 0000 0000 003")


def test_no_card_stays_in_a_long_run(spark):
    rng = random.Random(1)
    group = lambda: str(rng.randrange(1000, 10_000))
    texts, held = ["order 2024 4111 1111 1111 1111 paid", "2024 4111 1111 1111 1111 12 25", "no 1234 5678 9012 3456 7890 4111-1111-1111-1111", "12 34 4111 1111 1111 1111 56 78 90", "4111 1111 1111 1111  4111 1111 1111 1111"], [CARDS[0]] * 5
    held[2] = CARDS[1]
    for card in CARDS:
        for _ in range(6):
            before, after = (" ".join(group() for _ in range(rng.randrange(0, 6))) for _ in range(2))
            texts.append(f"x {before} {card} {after}, y")
            held.append(card)
    texts.append("n " + " ".join(group() for _ in range(2000)) + " " + CARDS[0])
    held.append(CARDS[0])
    got = [r.text for r in run(spark, texts)]
    for text, card, new in zip(texts, held, got):
        assert card not in new and len(new) == len(text), (text, new)
        assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", text)
    assert [r.text for r in run(spark, got, inverse=True)] == texts


def test_long_runs_without_a_card_stay_and_hide_nothing(spark):
    plain = " ".join(str(i) for i in range(100, 400))
    texts = [plain, "1" * 50, "12345678901234567890123", "10 20 30 40 50 123-45-6789 60 70", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 2024-02-29 15 16"]
    assert not luhn("1234567890123456789")
    got = [r.text for r in run(spark, texts)]
    assert got[:3] == texts[:3]
    assert "123-45-6789" not in got[3] and "2024-02-29" not in got[4]
    assert [r.text for r in run(spark, got, inverse=True)] == texts


def test_repeated_rows_and_very_long_texts(spark):
    long = ("word " * 100_000) + "card 4111 1111 1111 1111 mail a.b@example.com " + ("12 " * 30_000)
    got = [r.text for r in run(spark, [long, long])]
    assert got[0] == got[1] and len(got[0]) == len(long) and "4111 1111 1111 1111" not in got[0] and "a.b@" not in got[0]
