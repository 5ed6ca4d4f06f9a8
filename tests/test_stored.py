"""Stored state: repeated writes, buckets that stay, cycles that are run again."""
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests_cycle_frames import frames
from wirefold.operators import stored as SD
from wirefold.plans import cycle as CY
from wirefold.streaming import cycles as SC


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def files(path):
    return {d: {(f, os.stat(os.path.join(d, f)).st_mtime_ns) for f in names if f.endswith(".parquet")}
            for d, _, names in os.walk(path) if "bucket=" in d}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}", 0) for i in range(50)], "k long, v string, n int")
    return SD.KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["k"], 8).create(rows)


def test_changes_rewrite_their_buckets_only(spark, table):
    before, stored = files(table.path), table.read()
    changes = spark.createDataFrame([(3, "new", 1), (3, "newer", 2), (99, "added", 1)], "k long, v string, seq int")
    touched = {r[0] for r in changes.select(table._bucket("k")).collect()}
    table.upsert(changes, ["k"], ["v"], ["seq"], {"n": F.lit(7)})
    after = files(table.path)
    changed = {d for d in before if before[d] != after[d]}
    assert {int(d.rsplit("=", 1)[1]) for d in changed} == touched and len(touched) < 8
    want = {i: (f"v{i}", 0) for i in range(50)} | {3: ("newer", 0), 99: ("added", 7)}
    assert {r["k"]: (r["v"], r["n"]) for r in stored.sparkSession.read.schema(table._stored).parquet(table.path).filter("_live").collect()} == want
    once = rows_of(table.read())
    table.upsert(changes, ["k"], ["v"], ["seq"], {"n": F.lit(7)})
    assert rows_of(table.read()) == once


def test_update_delete_and_emptied_buckets(spark, table):
    table.update(spark.createDataFrame([(1, 5), (77, 5)], "k long, n int"), ["k"], ["n"])
    assert {r["k"]: r["n"] for r in table.read().collect()} == {i: 5 if i == 1 else 0 for i in range(50)}
    everything = table.read().select(F.col("k").alias("x"))
    table.delete(everything, "x")
    assert table.read().count() == 0            # no bucket kept its old rows
    table.delete(spark.range(3).select(F.col("id").alias("x")), "x")
    table.insert_or_ignore(spark.createDataFrame([(1, "a", 1, 0), (1, "b", 1, 1)], "k long, v string, n int, o int"), ["k"], ["o"])
    assert rows_of(table.read()) == [(1, "a", 1)]
    assert rows_of(table.copy_to(table.path + "-more", 32).read()) == [(1, "a", 1)]
    table.upsert(spark.createDataFrame([], "k long, v string, seq int"), ["k"], ["v"], ["seq"])
    assert rows_of(table.read()) == [(1, "a", 1)]


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "k long, v string")
    t = SD.KeyedTable(spark, str(tmp_path / "e"), none.schema, ["k"], 4).create(none)
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(1, None, 1)], "k long, v string, seq int"), ["k"], ["v"], ["seq"])
    assert rows_of(t.read()) == [(1, None)]


def test_a_cascade_that_was_lost_half_way_is_run_again(spark, tmp_path, monkeypatch):
    make = lambda name, rows, schema, by: SD.KeyedTable(spark, str(tmp_path / name), rows.schema, [by], 4).create(rows)
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    a = frame([(i,) for i in range(6)], "id long")
    b = frame([(10 + i, i % 6) for i in range(12)], "id long, a long")
    c = frame([(100 + i, 10 + i % 12) for i in range(24)], "id long, b long")
    tables = [(make("a", a, "", "id"), "id"), (make("b", b, "", "a"), "id"), (make("c", c, "", "b"), "id")]
    doomed = frame([(1,), (4,), (9,)], "id long")
    whole, calls = SD.KeyedTable.delete, []

    def broken(self, gone, column, returning=None):
        calls.append(self.path)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return whole(self, gone, column, returning)

    monkeypatch.setattr(SD.KeyedTable, "delete", broken)
    with pytest.raises(RuntimeError):
        SD.delete_stored_cascade(tables, doomed, "id")
    monkeypatch.setattr(SD.KeyedTable, "delete", whole)
    SD.delete_stored_cascade(tables, doomed, "id")
    assert rows_of(tables[0][0].read()) == [(i,) for i in (0, 2, 3, 5)]
    keep_b = [(10 + i, i % 6) for i in range(12) if i % 6 not in (1, 4)]
    assert rows_of(tables[1][0].read()) == sorted(keep_b, key=repr)
    assert rows_of(tables[2][0].read()) == sorted([(100 + i, 10 + i % 12) for i in range(24) if 10 + i % 12 in dict(keep_b)], key=repr)


def test_append_batches_replace_themselves(spark, tmp_path):
    path, schema = str(tmp_path / "log"), spark.createDataFrame([], "x long").schema
    for n in (SD.FIRST, 0, 1, 1):
        SD.append_batch(spark.createDataFrame([(n,)], "x long"), path, n)
    assert rows_of(SD.read_batches(spark, path, schema)) == [(-1,), (0,), (1,)]
    assert rows_of(SD.read_batches(spark, path, schema, before=1)) == [(-1,), (0,)]


def test_a_cycle_that_stopped_between_two_writes_is_run_again(spark, tmp_path, monkeypatch):
    sources, landing, news, sent, chats = frames(spark, ["apple", "river", "stone"])
    now = F.lit("2024-01-01").cast("timestamp")
    good = SC.CycleStore.create(str(tmp_path / "good"), news, sent)
    good.run_cycle(0, landing, sources, chats, now)
    whole = SC.append_batch
    for stop in range(1, 5):
        store, calls = SC.CycleStore.create(str(tmp_path / f"stop{stop}"), news, sent), []

        def broken(rows, path, batch_id, calls=calls, stop=stop):
            calls.append(path)
            if len(calls) == stop:
                raise RuntimeError("lost")
            whole(rows, path, batch_id)

        monkeypatch.setattr(SC, "append_batch", broken)
        with pytest.raises(RuntimeError):
            store.run_cycle(0, landing, sources, chats, now)
        monkeypatch.setattr(SC, "append_batch", whole)
        store.run_cycle(0, landing, sources, chats, now)
        store.run_cycle(0, landing, sources, chats, now)
        assert rows_of(store.news()) == rows_of(good.news())
        assert rows_of(store.sent()) == rows_of(good.sent())
        assert rows_of(store.outbox()) == rows_of(good.outbox())
    good.run_cycle(1, landing, sources, chats, now)     # nothing is new, all was sent
    assert good.outbox().filter("batch_id = 1").count() == 0 and good.news().count() == 3


def test_failed_deliveries_come_back(spark, tmp_path):
    sources, landing, news, sent, chats = frames(spark, ["apple", "river", "stone"])
    now = F.lit("2024-01-01").cast("timestamp")
    store = SC.CycleStore.create(str(tmp_path / "flow"), news, sent)
    some = lambda outbox: SC.all_delivered(outbox).withColumn("ok", F.col("news_id") != 2)
    store.run_cycle(0, landing, sources, chats, now, deliver=some)
    assert {(r["news_id"], r["sent_to_chat_id"]) for r in store.sent().collect()} == {(i, c) for i in (1, 3) for c in "ab"}
    store.run_cycle(1, landing, sources, chats, now)
    assert {(r["news_id"], r["chat_id"]) for r in store.outbox().filter("batch_id = 1").collect()} == {(2, "a"), (2, "b")}


def test_failed_enrichment_holds_back_its_rows_only(spark, tmp_path):
    """One bad batch gives its rows an error; the others are sent, and the bad ones come back."""
    words = ["apple", "river", "stone", "cloud", "violin", "harbor", "pepper", "candle"]
    sources, landing, news, sent, chats = frames(spark, words)
    now = F.lit("2024-01-01").cast("timestamp")

    def hook(pdf):
        if (pdf["id"] == 2).any():
            raise ValueError("no answer")
        return pd.DataFrame({"id": pdf["id"], "summary": "s"})

    store = SC.CycleStore.create(str(tmp_path / "flow"), news, sent)
    found = CY.news_cycle(sources, landing, news, sent, chats, now, summarize=hook, batch_size=3)
    failed = {r["id"]: r["error"] for r in found["failed"].collect()}
    assert len(failed) == 3 and set(failed.values()) == {"ValueError: no answer"} and 2 in failed
    assert {r["news_id"] for r in found["outbox"].collect()} == set(range(1, 9)) - set(failed)
    store.run_cycle(0, landing, sources, chats, now, summarize=hook, batch_size=3)
    store.run_cycle(1, landing, sources, chats, now, batch_size=3)
    assert {r["news_id"] for r in store.outbox().filter("batch_id = 1").collect()} == set(failed)
    assert [tuple(r) for r in store.counts().orderBy("batch_id").collect()] == [(8, 16, 6, 10, 0), (0, 6, 0, 6, 1)]
