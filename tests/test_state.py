"""Keyed state changes on the FIXTURES.md rows."""
from pyspark.sql import functions as F

from wirefold.operators import select as SEL
from wirefold.operators import state as ST


def test_insert_or_ignore_fixture(spark):
    rows = [(1, 1, "a", "u"), (2, 1, "b", "u"), (3, 1, None, "v"), (4, 1, "c", None), (5, 1, "d", None),
            (6, 9, "e", "w"), (7, 1, "f", ""), (8, 1, "g", ""), (9, 1, "h", "U")]
    ch = spark.createDataFrame(rows, "seq long, source_id long, title string, url string")
    sources = spark.createDataFrame([(1,)], "id long")
    rules = [("title_null", F.col("title").isNotNull())]
    ok = ST.validate(ch, rules).filter("accepted").drop("accepted", "reason")
    ok, _ = ST.fk_split(ok, sources, "source_id", "id")
    state = spark.createDataFrame([], "seq long, source_id long, title string, url string")
    new = ST.insert_or_ignore(state, ok, ["url"], ["seq"])
    assert sorted(r["title"] for r in new.collect()) == ["a", "c", "d", "f", "h"]


def test_insert_or_ignore_idempotent(spark):
    state = spark.createDataFrame([("x", 1)], "url string, v long")
    ch = spark.createDataFrame([("x", 2), ("y", 3), ("y", 4), (None, 5)], "url string, v long")
    once = ST.apply_insert_or_ignore(state, ch, ["url"], ["v"])
    twice = ST.apply_insert_or_ignore(once, ch.filter(F.col("url").isNotNull()), ["url"], ["v"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    assert {(r["url"], r["v"]) for r in once.collect()} == {("x", 1), ("y", 3), (None, 5)}


def test_unsent_fixture(spark):
    news = spark.createDataFrame([(1, 1, "2024-01-02"), (2, 2, "2024-01-01")], "id long, source_id long, fetched_at string")
    sources = spark.createDataFrame([(1, "s1"), (2, "s2")], "id long, name string")
    sent = spark.createDataFrame([(1, "A"), (1, "A")], "news_id long, sent_to_chat_id string")
    got_b = [r["id"] for r in SEL.unsent_news(news, sources, sent, "B").collect()]
    got_a = [r["id"] for r in SEL.unsent_news(news, sources, sent, "A").collect()]
    assert got_b == [1, 2] and got_a == [2]


def test_upsert_and_seed(spark):
    state = spark.createDataFrame([(1, True, 10)], "k long, admin boolean, v long")
    ch = spark.createDataFrame([(1, 1, 11), (1, 2, 12), (2, 1, 20)], "k long, seq long, v long")
    got = {r["k"]: (r["admin"], r["v"]) for r in ST.upsert(state, ch, ["k"], ["v"], ["seq"],
                                                             {"admin": F.lit(False)}).collect()}
    assert got == {1: (True, 12), 2: (False, 20)}
    empty = spark.createDataFrame([], "hour int, minute int")
    defaults = spark.createDataFrame([(9, 0), (12, 0)], "hour int, minute int")
    assert ST.seed_if_empty(empty, defaults).count() == 2
    assert ST.seed_if_empty(defaults.limit(1), defaults).count() == 1


def test_assign_ids_dense_in_order(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("k"))
    got = ST.assign_ids(rows, ["k"], 100, out="nid").orderBy("k").collect()
    assert [r["nid"] for r in got] == list(range(101, 1101))
