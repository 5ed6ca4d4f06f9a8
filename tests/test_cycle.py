"""The cycle's state: stored summaries, one call per id, refused items, history."""
import os

import pandas as pd
from pyspark.sql import functions as F

from tests_cycle_frames import frames
from wirefold.plans import cycle as CY

def test_each_id_is_enriched_once_and_stored(spark, tmp_path):
    log = str(tmp_path)

    def hook(pdf):
        for i in pdf["id"]:
            with open(os.path.join(log, "calls"), "a") as f:
                f.write(f"{i}\n")
        return pd.DataFrame({"id": pdf["id"], "summary": "s" + pdf["id"].astype(str)})

    sources, landing, news, sent, chats = frames(spark, ["apple", "river", "stone", "cloud", "violin", "harbor", "pepper"])
    now = F.lit("2024-01-01").cast("timestamp")
    first = CY.news_cycle(sources, landing, news, sent, chats, now, summarize=hook)
    assert first["outbox"].count() == 14
    stored = first["news"]
    assert {r["summary_tr"] for r in stored.collect()} == {f"s{i}" for i in range(1, 8)}
    second = CY.news_cycle(sources, landing, stored, sent, chats, now, summarize=hook)
    assert second["outbox"].count() == 14 and second["new_rows"].count() == 0
    calls = (tmp_path / "calls").read_text().split()
    assert sorted(calls) == sorted(str(i) for i in range(1, 8))


def test_items_that_break_a_rule_are_refused(spark):
    items = spark.createDataFrame(
        [("rss", 1, 0, "t", "", "u1", None, False), ("rss", 1, 1, None, "", "u2", None, False), ("rss", 9, 0, "t", "", "u3", None, False)],
        "source_type string, source_id long, pos int, title string, content string, url string, published_at string, is_column boolean")
    sources, _, news, _, _ = frames(spark, ["x"])
    after, new = CY.ingest(news, items, F.lit("2024-01-01").cast("timestamp"), sources)
    assert [r["url"] for r in new.collect()] == ["u1"] and after.count() == 1


def test_history_is_compared_only_on_request(spark):
    sources, landing, news, sent, chats = frames(spark, ["apple"])
    old = spark.createDataFrame([(1, 1, "Apple", "apple says something else apple every 0 time", "http://old", None, None, "done", False)], news.schema)
    sent = spark.createDataFrame([(1, "a", None)], sent.schema)
    now = F.lit("2024-01-01").cast("timestamp")
    run = lambda flag: {(r["chat_id"], r["news_id"]) for r in CY.news_cycle(
        sources, landing, old, sent, chats, now, against_history=flag)["outbox"].collect()}
    # chat b has both rows pending: the newer one removes its copy
    assert run(False) == {("a", 2), ("b", 2)}
    assert run(True) == {("b", 2)}
