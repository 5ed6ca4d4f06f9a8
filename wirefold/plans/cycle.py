"""One delivery cycle as a function of input frames.

    sources, landing, news, sent  ->  news', outbox, sent'

1. active sources; landed bodies of those sources become items (A7);
2. items with a title, of a known source (I6, C3), not seen before (by url,
   first arrival wins) get ids in arrival order and ``fetched_at = now`` (I1, I8, A8);
3. the newest ``limit`` rows not yet sent to the chat, with source name
   (C1, C2, F1);
4. near-duplicates among them removed, first wins (H10);
5. rows without a summary go to the enrichment function in batches, each id
   once whatever the number of chats, and news' stores the answers (K1, C4, I4);
6. each row rendered into the outbox (B13); the sent log gains the rows whose
   delivery succeeded (J3).

The cycle is empty when no source is active, when nothing was fetched (even
if older rows are pending) or when nothing is pending; those guards are
EXISTS subqueries in the plan, not driver-side branches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wirefold.functions import text as T
from wirefold.operators import dedup as D
from wirefold.operators import enrich as EN
from wirefold.operators import select as SEL
from wirefold.operators import similarity as S
from wirefold.operators import state as ST
from wirefold.session import cut_lineage
from wirefold.sources import extract as X

ARRIVAL = ["source_type", "source_id", "pos"]


def item_rules() -> list[tuple[str, Column]]:
    """What an item must have to be stored."""
    return [("title_null", F.col("title").isNotNull())]


def ingest(news: DataFrame, items: DataFrame, now: Column, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(news', new rows): unseen items get ids after the current maximum in
    arrival order, ``fetched_at = now`` and no summary. Items that break a rule
    or whose source doesn't exist are refused."""
    valid = ST.validate(items, item_rules()).filter("accepted").select(*items.columns)
    known, _ = ST.fk_split(valid, sources, "source_id", "id")
    fresh = cut_lineage(ST.insert_or_ignore(news.select("url"), known, ["url"], ARRIVAL))
    base = news.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = ST.assign_ids(fresh, ARRIVAL, base, out="id")
    new_rows = cut_lineage(fresh.select(
        "id", "source_id", "title", "content", "url", "published_at",
        now.alias("fetched_at"), F.lit(None).cast("string").alias("summary_tr"), "is_column"))
    return ST.append_rows(news, new_rows), new_rows


def dedup_pending(pending: DataFrame, threshold: float = S.SIMILARITY_THRESHOLD,
                  history: DataFrame | None = None) -> DataFrame:
    """Rows of ``pending`` that stay: near-duplicates within each chat go
    (one batch per chat, position = newest first). With ``history`` (chat_id,
    id, title, content: rows the chat already has) a pending row also goes if
    it is near one of those; they come before all pending rows and stay."""
    docs = pending.select(F.col("chat_id").alias("batch"), F.col("rank").cast("long").alias("pos"),
                          T.corpus_text(F.col("title"), F.col("content")).alias("norm"))
    if history is not None:
        # negative positions: before every rank, newest id first
        docs = docs.unionByName(history.select(F.col("chat_id").alias("batch"), (-F.col("id")).cast("long").alias("pos"),
                                               T.corpus_text(F.col("title"), F.col("content")).alias("norm")))
    flags = D.dedup_flags(docs, threshold, max_features=S.MAX_FEATURES if history is None else None)
    flags = flags.select(F.col("batch").alias("chat_id"), F.col("pos").alias("rank"), "keep").filter("rank > 0")
    return pending.join(flags, ["chat_id", "rank"]).filter(F.col("keep")).drop("keep")


def sent_rows(news: DataFrame, sent: DataFrame, chats: DataFrame, chat_col: str = "sent_to_chat_id") -> DataFrame:
    """(chat_id, id, title, content) of the news that each chat was sent."""
    log = sent.select(F.col(chat_col).alias("chat_id"), F.col("news_id").alias("id")).distinct()
    log = log.join(chats.select("chat_id").distinct(), "chat_id", "left_semi")
    return log.join(news.select("id", "title", "content"), "id").select("chat_id", "id", "title", "content")


def enrich_pending(kept: DataFrame, summarize: Callable[[pd.DataFrame], pd.DataFrame],
                   batch_size: int = EN.BATCH_SIZE) -> DataFrame:
    """(id, summary, error) of the rows without a summary; a row that is pending
    for several chats goes to ``summarize`` once. Rows of a batch whose call
    failed have the error and no summary."""
    todo = kept.filter(F.coalesce(F.col("summary_tr"), F.lit("")) == "").select("id", "content").dropDuplicates(["id"])
    todo = EN.summary_batches(cut_lineage(todo), [], ["id"], batch_size)
    return cut_lineage(EN.enrich_batches(todo, summarize, ["batch_no"], errors=True).dropDuplicates(["id"]))


def news_cycle(sources: DataFrame, landing: DataFrame, news: DataFrame, sent: DataFrame,
               chats: DataFrame, now: Column, limit: int = SEL.PENDING_LIMIT,
               threshold: float = S.SIMILARITY_THRESHOLD,
               summarize: Callable[[pd.DataFrame], pd.DataFrame] = EN.first_sentence_summaries,
               batch_size: int = EN.BATCH_SIZE, against_history: bool = False,
               count_pending: Observation | None = None) -> dict[str, DataFrame]:
    """Run one cycle for every chat in ``chats`` (chat_id). Returns news' (with
    the new summaries), the rows added, the pending rows, the outbox
    (chat_id, rank, news_id, message), the summaries found (id, summary_tr) and
    the rows whose enrichment failed (id, error), which are not in the outbox. ``against_history`` also compares the
    pending rows with what each chat was sent before."""
    # the fetched items feed both the ingest and the "anything fetched" guard
    items = cut_lineage(X.fetch_all_active(sources, landing))
    news2, new_rows = ingest(news, items, now, sources)
    pending = SEL.unsent_per_chat(news2, sources, sent, chats, limit)
    # guards: nothing fetched this cycle, or no active source -> nothing sent
    # (pending is at most limit rows per chat; written once, read by every
    # later step instead of re-running the fetch and ingest)
    pending = pending.filter(items.exists())
    if count_pending is not None:  # counted while it is written
        pending = pending.observe(count_pending, F.count(F.lit(1)).alias("n"))
    pending = cut_lineage(pending)
    kept = cut_lineage(dedup_pending(pending, threshold, sent_rows(news2, sent, chats) if against_history else None))
    answers = enrich_pending(kept, summarize, batch_size)
    failed = answers.filter(F.col("error").isNotNull()).select("id", "error")
    summaries = answers.filter(F.col("error").isNull()).select("id", "summary")
    # rows whose enrichment failed are not sent: they come back in the next cycle
    kept = EN.apply_summaries(kept.join(failed.select("id"), "id", "left_anti"), summaries)
    stored = summaries.select("id", F.col("summary").alias("summary_tr"))
    news3 = ST.update_by_key(news2, stored, ["id"], ["summary_tr"], flag=None)
    outbox = kept.select("chat_id", "rank", F.col("id").alias("news_id"), T.render_message(
        F.col("title"), F.col("summary_tr"), F.col("content"), F.col("source_name"), F.col("url"),
        F.col("is_column")).alias("message"))
    return {"news": news3, "new_rows": new_rows, "pending": pending, "outbox": outbox, "summaries": stored, "failed": failed}


def delivered(sent: DataFrame, results: DataFrame) -> DataFrame:
    """Rows to append to the sent log after a delivery round, in its schema:
    sends that succeeded (``ok``), once per (news_id, chat_id) of this round; a
    failed send is not logged and comes back next cycle. Re-applying the same
    results adds nothing (anti join on the pair against the log)."""
    done = (results.filter(F.col("ok"))
            .select("news_id", F.col("chat_id").alias("sent_to_chat_id"), "message_id")
            .dropDuplicates(["news_id", "sent_to_chat_id"]))
    fresh = done.join(sent.select("news_id", "sent_to_chat_id"), ["news_id", "sent_to_chat_id"], "left_anti")
    return ST.append_rows(sent.limit(0), fresh)


def delivery_log(sent: DataFrame, results: DataFrame) -> DataFrame:
    """Sent log after a delivery round (``delivered`` appended)."""
    return ST.append_rows(sent, delivered(sent, results))


def cycle_counts(new_rows: DataFrame, pending: DataFrame, outbox: DataFrame) -> DataFrame:
    """One row per chat: rows added this cycle, pending, removed as
    duplicates, sent."""
    p = pending.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_pending"))
    o = outbox.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_sent"))
    n_new = new_rows.agg(F.count(F.lit(1))).scalar()
    return (p.join(o, "chat_id", "left")
            .select("chat_id", n_new.alias("n_added"), "n_pending",
                    (F.col("n_pending") - F.coalesce(F.col("n_sent"), F.lit(0))).alias("n_removed"),
                    F.coalesce(F.col("n_sent"), F.lit(0)).alias("n_sent")))
