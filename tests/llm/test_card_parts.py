import pytest

from .test_pseudonyms import luhn, run

CARD = "4111111111111111"
SPACED = "4111 1111 1111 1111"
CASES = [
    ("card {} 12/25", CARD), ("{} 123", SPACED), ("{} 12", CARD), ("{}-12", CARD), ("12 {}", SPACED), ("7 {} 12 ok", CARD), ("{} 1", SPACED),
    *(("{} " + f"{i:02d}", CARD) for i in range(10, 30)),
]


def test_cards_beside_other_numbers(spark):
    texts = [form.format(card) for form, card in CASES]
    got = [r.text for r in run(spark, texts)]
    for text, (form, card), new in zip(texts, CASES, got):
        head, rest = form.split("{}")
        assert luhn(card) and card not in new and len(new) == len(text), (text, new)
        if not luhn("".join(c for c in text if c.isdigit())) and "/" not in form:
            assert new.startswith(head) and new.endswith(rest) and luhn(new[len(head) : len(new) - len(rest)]), (text, new)
    assert [r.text for r in run(spark, got, inverse=True)] == texts


@pytest.mark.parametrize("text", ["4111 1111 1111 1112 13", "12 34 56 78 90 12", "1234567890123456789"])
def test_runs_without_a_card_stay(spark, text):
    assert [r.text for r in run(spark, [text])] == [text]
