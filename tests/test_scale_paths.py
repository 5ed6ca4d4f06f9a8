"""The paths that only run at scale, forced on small inputs and checked
against a plain answer."""
from pyspark.sql import functions as F

from wirefold.operators import report as RP
from wirefold.operators import select as SEL
from wirefold.operators import similarity as S
from wirefold.operators.ordinal import keyed_ordinal


def test_keyed_ordinal_hot_key_spans_partitions(spark):
    # one key holds most rows; 7 range partitions split it
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 5}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = keyed_ordinal(df.withColumn("m", F.lit(2.0)), ["k"], ["o"], out="rn", measure="m",
                        cum_out="before", num_partitions=7).collect()
    by_key = {}
    for r in sorted(got, key=lambda r: (r["k"], r["o"])):
        by_key.setdefault(r["k"], []).append((r["rn"], r["before"]))
    for k, seq in by_key.items():
        assert [rn for rn, _ in seq] == list(range(1, len(seq) + 1)), k
        assert [b for _, b in seq] == [2.0 * i for i in range(len(seq))], k


def test_unsent_per_chat_equals_brute_force(spark):
    import random
    rnd = random.Random(4)
    news = [(i, i % 4, f"2024-01-{1 + i % 9:02d}") for i in range(1, 120)]          # source 3 is unknown
    sources = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, name string")
    sent = [(i, "all") for i in range(1, 120)] + [(i, "half") for i in range(1, 120) if rnd.random() < .5]
    sent += [(i, "newest") for i in range(60, 120)] + [(7, "dup"), (7, "dup"), (999, "dup")]
    chats = spark.createDataFrame([(c,) for c in ("all", "half", "newest", "dup", "none", "none")], "chat_id string")
    got = SEL.unsent_per_chat(spark.createDataFrame(news, "id long, source_id long, fetched_at string"), sources,
                              spark.createDataFrame(sent, "news_id long, sent_to_chat_id string"), chats, limit=10).collect()
    order = sorted((r for r in news if r[1] != 3), key=lambda r: (r[2], r[0]), reverse=True)
    want = {(c, k + 1, r[0]) for c in ("all", "half", "newest", "dup", "none")
            for k, r in enumerate([r for r in order if (r[0], c) not in set(sent)][:10])}
    assert {(r["chat_id"], r["rank"], r["id"]) for r in got} == want and len(got) == len(want)


def test_growing_windows_equal_brute_force(spark, monkeypatch):
    import datetime as dt
    import random
    monkeypatch.setattr(SEL, "WINDOW_GROWTH", 2)
    rnd = random.Random(5)
    day = dt.datetime(2024, 1, 1)
    news = [(i, i % 3, None if i % 50 == 0 else day + dt.timedelta(hours=rnd.randrange(300))) for i in range(1, 400)]
    sent = [(i, "old only") for i, _, t in news if t and t > day + dt.timedelta(hours=60)]
    sent += [(i, "some") for i, _, _ in news if rnd.random() < .6] + [(i, "all") for i, _, _ in news]
    chats = ["old only", "some", "all", "none"]
    frame = spark.createDataFrame(news, "id long, source_id long, fetched_at timestamp_ntz")
    starts = SEL.window_starts(frame, 20, 2)
    assert len(starts) > 3 and starts[-1] is None and starts[:-1] == sorted(starts[:-1], reverse=True)
    got = SEL.unsent_per_chat(frame, spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, name string"),
                              spark.createDataFrame(sent, "news_id long, sent_to_chat_id string"),
                              spark.createDataFrame([(c,) for c in chats], "chat_id string"), limit=30, first_window=20).collect()
    order = sorted(news, key=lambda r: (r[2] or dt.datetime.min, r[0]), reverse=True)
    want = {(c, k + 1, r[0]) for c in chats for k, r in enumerate([r for r in order if (r[0], c) not in set(sent)][:30])}
    assert {(r["chat_id"], r["rank"], r["id"]) for r in got} == want and len(got) == len(want)


def test_fresh_rows_are_found_in_the_newest_window(spark, monkeypatch):
    """Chats with fresh rows are settled by the first window; the rest of the news is not ranked."""
    sizes = []
    whole = SEL.unsent_ranks
    monkeypatch.setattr(SEL, "unsent_ranks", lambda ranked, *a: sizes.append(ranked.count()) or whole(ranked, *a))
    news = spark.range(1, 20_001).selectExpr("id", "0 AS source_id", "timestamp_seconds(id) AS fetched_at")
    sources = spark.createDataFrame([(0, "a")], "id long, name string")
    sent = spark.range(1, 19_901).selectExpr("id AS news_id", "'c' AS sent_to_chat_id")
    chats = spark.createDataFrame([("c",), ("d",)], "chat_id string")
    out = SEL.unsent_per_chat(news, sources, sent, chats, limit=50, first_window=200)
    assert out.count() == 100 and out.agg({"id": "min"}).first()[0] == 19_951
    assert len(sizes) == 1 and sizes[0] <= 400


def test_unsent_for_many_chats_without_a_product(spark):
    news = spark.range(1, 3001).selectExpr("id", "id % 2 AS source_id", "id AS fetched_at")
    sources = spark.createDataFrame([(0, "a"), (1, "b")], "id long, name string")
    chats = spark.range(20000).selectExpr("concat('c', id) AS chat_id")
    sent = spark.range(20000).selectExpr("3000L - id % 5 AS news_id", "concat('c', id) AS sent_to_chat_id")
    out = SEL.unsent_per_chat(news, sources, sent, chats, limit=3)
    assert out.count() == 60000
    assert out.filter("rank = 1 AND id <> 3000").count() == 4000   # those whose newest was sent
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_chunked_report_equals_python(spark):
    lines = spark.createDataFrame([("rss", i, f"line {i} " + "x" * (i % 13)) for i in range(1, 60)],
                                  "source_type string, id long, line string")
    got = RP.chunked_report(lines, ["source_type", "id"], "HEAD", chunk=37).orderBy("piece_no").collect()
    text = "HEAD\n" + "\n".join(f"line {i} " + "x" * (i % 13) for i in range(1, 60))
    assert [r["piece"] for r in got] == [text[i:i + 37] for i in range(0, len(text), 37)]


def test_pairs_equal_all_dot_products(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon eta",
             "one two three four five six", "one two three four five seven", "alpha two gamma four", "", "alpha beta gamma delta epsilon zeta"]
    docs = spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(texts)], "batch string, pos long, t string")
    docs = docs.select("batch", "pos", S.T.corpus_text(F.lit(None).cast("string"), F.col("t")).alias("norm"))
    for cap in (5000, None, 8):
        w = S.tfidf(docs, cap)
        rows = {}
        for r in w.collect():
            rows.setdefault(r["pos"], {})[r["term"]] = r["weight"]
        want = {(i, j): sum(x * rows[j].get(t, 0) for t, x in rows[i].items()) for i in rows for j in rows if i < j}
        got = {(r["i"], r["j"]): r["sim"] for r in S.similar_pairs(w, 0.3).collect()}
        assert set(got) == {k for k, v in want.items() if v >= 0.3}
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_no_size_guard_is_left():
    from wirefold.operators import dedup as D
    for module in (S, D, SEL):
        assert not any(n.startswith("MAX_CANDIDATE") or n.startswith("MAX_BROADCAST") or n.endswith("LimitError") for n in dir(module))


def test_keyed_ordinal_default_partitioning(spark):
    rows = [("hot", i) for i in range(5000)] + [(f"k{i % 7}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long").repartition(11)
    got = keyed_ordinal(df, ["k"], ["o"], out="rn").collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append((r["o"], r["rn"]))
    for k, seq in by_key.items():
        seq.sort()
        assert [rn for _, rn in seq] == list(range(1, len(seq) + 1)), k


def test_vocabulary_in_parts_equals_one_sort(spark):
    rows = [("b", f"t{i}", 1, i % 7) for i in range(300)] + [("c", f"t{i}", 1, i % 3) for i in range(20)]
    dfs = spark.createDataFrame(rows, "batch string, term string, df long, total long")
    want = {(b, t, r) for b in "bc" for r, (t, _) in enumerate(sorted(((x[1], x[3]) for x in rows if x[0] == b),
                                                                     key=lambda x: (-x[1], x[0]))[:50], 1)}
    for n in (1000, 30):
        got = S.vocabulary(dfs, 50, terms_per_sort=n).collect()
        assert {(r["batch"], r["term"], r["vrank"]) for r in got} == want


def test_terms_of_a_batch_stay_in_one_task(spark):
    docs = spark.createDataFrame([(f"b{i % 9}", i, f"some words of text {i} and {i % 4}") for i in range(90)], "batch string, pos long, norm string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = S.dealt(docs)
        assert d.whole and d.unique and d.rows == 10
        for df in (S.vocabulary(S.doc_freq(S.term_freq(d.docs)), whole=True), S.tfidf_rows(d), S.prefix_terms(S.tfidf(docs, d=d), 0.75, d)):
            assert "ENSURE_REQUIREMENTS" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_weights_are_the_same_however_rows_are_dealt(spark):
    rows = [("b", i, f"alpha w{i % 3} w{i % 5} beta") for i in range(12)] + [("b", 3, "alpha gamma"), ("c", 1, ""), ("c", 2, "x y"), (None, 1, "lost words")]
    docs = spark.createDataFrame(rows, "batch string, pos long, norm string")
    whole, cut = S.dealt(docs), S.dealt(docs, task_chars=20, batch_chars=20)
    assert whole.whole and not cut.whole and not whole.unique and cut.tasks > whole.tasks
    for cap in (None, 4):
        got = [{(r["batch"], r["pos"], r["term"], r["df"]): round(r["weight"], 9) for r in S.tfidf(docs, cap, d=d).collect()} for d in (whole, cut)]
        assert got[0] == got[1] and got[0]


def test_keyed_ordinal_sorts_a_bounded_number_of_rows_a_task(spark, monkeypatch):
    from wirefold.operators import ordinal
    monkeypatch.setattr(ordinal, "ROWS_PER_TASK", 100)
    df = spark.range(5000).selectExpr("'hot' AS k", "id AS o")
    out = keyed_ordinal(df, ["k"], ["o"], out="rn")
    sizes = out.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] < 400 and sizes[1] > 20   # AQE would merge them into one task
    assert out.filter("rn <> o + 1").isEmpty()
