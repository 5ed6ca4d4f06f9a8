import random

from pyspark.sql import functions as F

from wirefold.llm.langid import BLOCK, Parser, identify_language, predict_language, suffix_automaton

A = "the quick brown fox jumps over the lazy dog while the other animals watch from the hill and say nothing "
B = "der schnelle braune fuchs springt ueber den faulen hund waehrend die anderen tiere zusehen und schweigen "


def brute_phrases(text, sample):
    i = count = 0
    while i < len(text):
        n = 1
        while i + n < len(text) + 0 and text[i:i + n + 1] in sample:
            n += 1
        count += 1
        i += n
    return count


def test_automaton_accepts_exactly_the_substrings():
    rnd = random.Random(1)
    s = [rnd.randrange(3, 6) for _ in range(60)]
    states = suffix_automaton(s)
    subs = {tuple(s[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for n in range(1, 7):
        for _ in range(200):
            w = tuple(rnd.randrange(3, 6) for _ in range(n))
            at = 0
            for c in w:
                at = states[at].get(c, -1) if at >= 0 else -1
            assert (at >= 0) == (w in subs)


def test_phrase_counts_equal_brute_force():
    parser = Parser((("a", A), ("b", B)))
    rnd = random.Random(8)
    mixed = " ".join(rnd.choice(("the quick", "fox jumps over", "schnelle braune", "zz", "hill")) for _ in range(900))
    for text in (A[10:90], B[5:70], "zzz foo the fox qqq", "dog", "x", A + B, A * 9, "a" * (2 * BLOCK), "a" * (2 * BLOCK + 1), mixed):
        symbols = "".join(map(chr, parser.symbols(text).tolist()))
        cost, n, _ = parser.costs([text])
        for j, sample in enumerate((A, B)):
            s = "".join(map(chr, parser.symbols(sample).tolist()))
            want = brute_phrases(symbols, s)
            assert abs(cost[0, j] * n[0] / parser.weights[j] - want) < 1e-6, (text, j)


def test_edge_rows(docs_frame, edge_rows):
    out = identify_language(docs_frame(edge_rows)).collect()
    assert len(out) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert not any(r["held_out"] for r in out if r["doc_id"] is None)
    assert identify_language(docs_frame([])).count() == 0
    assert {r["lang_pred"] for r in identify_language(docs_frame([(1, "abc", None)])).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify_language(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    held = out.filter("held_out AND n >= 40")
    right = held.filter("lang = lang_pred").count() / held.count()
    assert right >= 0.95


def test_languages_of_many_scripts_and_labels(docs_frame):
    # 110 labels with 4 letters each: more letters and labels than one small alphabet or list holds
    own = {f"l{i:03}": [chr(0x4E00 + 4 * i + k) for k in range(4)] for i in range(110)}
    rnd = random.Random(4)
    rows = [(n, "".join(rnd.choice(letters) for _ in range(40)), lang)
            for n, (lang, letters) in enumerate([x for x in own.items() for _ in range(12)])]
    got = {r["doc_id"]: r["lang_pred"] for r in identify_language(docs_frame(rows)).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_sparse_transitions_equal_dense_ones(monkeypatch):
    texts = [A[10:90], B[5:70], "zzz foo the fox qqq ж", A + B, "", (A + B) * 8, "x" * 600]
    dense = Parser((("a", A), ("b", B))).costs(texts)[0]
    monkeypatch.setattr("wirefold.llm.langid.DENSE_CELLS", 0)
    assert (Parser((("a", A), ("b", B))).costs(texts)[0] == dense).all()


def test_ties_go_to_the_language_that_sorts_first(spark):
    docs = spark.createDataFrame([(1, "common words of both"), (2, "words"), (3, "both" * 200)], "doc_id long, text string")
    samples = (("aa", "common words of both"), ("bb", "common words of both"))
    assert {(r["lang_pred"], r["score"]) for r in predict_language(docs, samples, ["doc_id"]).collect()} == {("aa", 0.0)}


def test_costs_do_not_depend_on_the_other_texts():
    parser = Parser((("a", A), ("b", B)))
    texts = [A * 7, "", B * 11, "dog", (A[:40] + B[:50]) * 20]
    together = parser.costs(texts)[0]
    assert all((parser.costs([t])[0][0] == together[i]).all() for i, t in enumerate(texts))
