from rasterloom.llm import quality_rules as q


def slow_repeat(w):
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


def test_figures(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "x " * 40, "1 2 3 4 5 6 7 8 9 10 11", "# $ a|b\n\na\t\na\n a\nb\nb", "", None, "é ü\x0b\x0cñ", "p q r s t u p q r s t v p q r s t"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, _f_w int")
    got = {r.doc_id: r.f for r in q.text_figures(df, "text", "f").collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), slow_repeat(w)), t
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "")


def test_frequent_lines_go_and_depleted_documents_too(spark):
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    banner = "Subscribe to our news letter now and get all of it in your mail every single day"
    rows = [(i, f"{own(i)}\n{banner.upper() if i % 2 else '  ' + banner}", "h", 9) for i in range(40)]
    rows += [(100, f"{banner}\nfew words", "h", 9), (101, f"{banner}\n{own(101)}", "other", 9), (102, None, None, 9)]
    # Copies of one document count once.
    rows += [(200 + i, own(200), "h", 9) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality int")
    got = {r.doc_id: r["_quality"] for r in q.judge(df).collect()}
    assert all(got[i].kept and got[i].removed_words == 17 for i in range(40))
    assert not got[100].kept and not got[100].base_failed and got[101].kept and got[101].removed_words == 0 and got[102].base_failed and all(got[200 + i].kept for i in range(60))
    clean = {r.doc_id: r.text for r in q.clean(df).collect()}
    assert clean[3] == own(3) and clean[101].startswith("Subscribe") and len(clean) == 101
    assert q.clean(df.limit(0)).columns == df.columns
