import re
from collections import Counter

from rasterloom.llm import divergence as D


def brute(rows, min_docs, top):
    groups, df, total = {}, Counter(), Counter()
    for lang, source, text in rows:
        terms = re.findall(D.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        lang = lang or ""
        groups.setdefault((lang, source or ""), Counter()).update(terms)
        df.update((lang, t) for t in set(terms))
        total.update((lang, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (a, t), n in df.items() if a == lang and n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q, p = share({t: total[lang, t] for t in kept}), {s: share(c) for (a, s), c in groups.items() if a == lang}
        for s in p:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][t] - q[t], t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(pairs)] + [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(terms)]
    return sorted(out)


def test_equals_brute_force_with_odd_rows(spark):
    rows = [("en", "a", "The cat the CAT Äb äb € x1y"), ("en", "a", "the dog"), ("en", "b", "the cat cat cat"), ("en", "c", None), ("en", "c", ""), ("en", None, "dog dog the"), (None, "a", "le chat"), ("", "", "le chien le"), (None, None, "le"), ("de", "only", "das das"), ("fr", "p", "un"), ("fr", "q", "deux"), ("en", "b", "the cat cat cat"), ("en", "d", "emoji\U0001f600s the " * 2000)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, n int, term string")
    for least, top in ((2, 50), (1, 2), (9, 50)):
        assert sorted(map(tuple, D.audit(docs, least, top).collect())) == brute(rows, least, top)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
