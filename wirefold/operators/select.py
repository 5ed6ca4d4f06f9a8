"""Selecting what to deliver: joins to sources, not-yet-sent rows, newest-N.

All operators take and return DataFrames. Tie-break of "newest" is fixed as
``fetched_at DESC, id DESC`` so that results repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.operators.ordinal import keyed_ordinal
from wirefold.session import cut_lineage

PENDING_LIMIT = 50          # rows considered per cycle per chat


def with_source(news: DataFrame, sources: DataFrame) -> DataFrame:
    """Inner join on ``news.source_id = sources.id`` adding ``source_name``.

    The active flag is not tested (a disabled source's news is still
    delivered). No broadcast hint: the planner broadcasts the sources only
    when their measured size is under the broadcast threshold (AQE re-plans
    with the real size), and shuffles both sides otherwise."""
    s = sources.select(F.col("id").alias("_sid"), F.col("name").alias("source_name"))
    return news.join(s, news["source_id"] == s["_sid"], "inner").drop("_sid")


def newest_order() -> list[Column]:
    return [F.col("fetched_at").desc(), F.col("id").desc()]


def unsent(news: DataFrame, sent: DataFrame, chat_id: str,
           chat_col: str = "sent_to_chat_id") -> DataFrame:
    """Rows with no sent-log row for this id and chat (NOT EXISTS -> anti join;
    the chat filter reaches the parquet scan)."""
    s = sent.filter(F.col(chat_col) == F.lit(chat_id)).select(F.col("news_id").alias("_nid"))
    return news.join(s, news["id"] == s["_nid"], "left_anti")


def unsent_news(news: DataFrame, sources: DataFrame, sent: DataFrame, chat_id: str,
                limit: int = PENDING_LIMIT) -> DataFrame:
    """Newest ``limit`` rows not yet sent to ``chat_id``, with source name.

    The top rows are chosen over (id, source, time) alone: a semi join to the
    sources, an anti join to the log and a per-task top-k. Only those
    ``limit`` rows then fetch the other columns and the name."""
    known = news.join(sources.select(F.col("id").alias("_sid")), F.col("source_id") == F.col("_sid"), "left_semi")
    top = unsent(known.select("id", "source_id", "fetched_at"), sent, chat_id).orderBy(*newest_order()).limit(limit)
    rows = news.join(top.select(F.col("id").alias("_top")), F.col("id") == F.col("_top"), "left_semi")
    return with_source(rows, sources).orderBy(*newest_order())


def chats_of(sent: DataFrame, chat_col: str = "sent_to_chat_id") -> DataFrame:
    return sent.select(F.col(chat_col).alias("chat_id")).distinct()


def unsent_ranks(ranked: DataFrame, sent: DataFrame, chats: DataFrame, limit: int,
                 chat_col: str = "sent_to_chat_id") -> DataFrame:
    """(chat_id, rank, r): for each chat the news ranks r of its first
    ``limit`` unsent rows, counted instead of listed.

    If a chat's k-th sent row (newest first) has news rank r, then r - k rows
    before it are unsent. So the u-th unsent row has rank u plus the number of
    sent rows with r - k < u: counts of sent rows by min(r - k, limit), summed
    over at most ``limit`` values per chat. No news x chats product; the log
    is aggregated map-side and a chat with most of the log is split."""
    log = (sent.select(F.col(chat_col).alias("chat_id"), F.col("news_id").alias("id")).distinct()
           .join(ranked, "id").select("chat_id", "r"))
    gaps = keyed_ordinal(log, ["chat_id"], ["r"], out="k")
    counts = (gaps.select("chat_id", (F.col("r") - F.col("k")).alias("gap")).filter(F.col("gap") < limit)
              .groupBy("chat_id", "gap").agg(F.count(F.lit(1)).alias("n")))
    slots = (chats.select("chat_id").distinct()
             .withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(limit)))))
    upto = Window.partitionBy("chat_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (slots.join(counts.select("chat_id", (F.col("gap") + 1).cast("int").alias("rank"), "n"), ["chat_id", "rank"], "left")
            .withColumn("r", F.col("rank") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
            .select("chat_id", "rank", "r"))


#: Newest rows that are looked at first; the window grows by ``WINDOW_GROWTH`` for chats that need more.
FIRST_WINDOW, WINDOW_GROWTH = 2_000, 8


def window_starts(news: DataFrame, first: int = FIRST_WINDOW, growth: int = WINDOW_GROWTH) -> list:
    """Values of ``fetched_at``, newest first: about ``first`` rows are at or
    after the first of them, ``growth`` times as many at or after the next, and
    so on; the last is None (all rows). They are quantiles of one narrow
    aggregate; how exact they are changes the windows' sizes only."""
    kind = news.schema["fetched_at"].dataType
    total = news.count()
    shares, size = [], first
    while size < total and isinstance(kind, (T.NumericType, T.DatetimeType)):
        shares.append(1.0 - size / total)
        size *= growth
    if not shares:
        return [None]
    found = news.agg(F.percentile_approx("fetched_at", shares, 100_000)).first()[0] or []
    return [*dict.fromkeys(found), None]


def _pending_ranks(known: DataFrame, news: DataFrame, sent: DataFrame, chats: DataFrame, limit: int,
                   chat_col: str, first: int) -> tuple[DataFrame, DataFrame]:
    """(ranks of the pending rows by chat, ids by rank of the largest window read)."""
    todo, settled = cut_lineage(chats.select("chat_id").distinct()), []
    for start in window_starts(news, first):
        window = known if start is None else known.filter(F.col("fetched_at") >= F.lit(start))
        ranked = cut_lineage(keyed_ordinal(window.select("id", "fetched_at"), [], newest_order(), out="r").select("id", "r"))
        size = ranked.count()
        log = sent.join(todo.withColumnRenamed("chat_id", chat_col), chat_col, "left_semi")
        ranks = cut_lineage(unsent_ranks(ranked, log, todo, limit, chat_col).filter(F.col("r") <= size))
        full = ranks.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == limit)
        if start is None:
            settled.append(ranks)
            break
        settled.append(ranks.join(full, "chat_id", "left_semi"))
        todo = cut_lineage(todo.join(full, "chat_id", "left_anti"))
        if todo.isEmpty():
            break
    return reduce(lambda a, b: a.unionByName(b), settled), ranked


def unsent_per_chat(news: DataFrame, sources: DataFrame, sent: DataFrame, chats: DataFrame,
                    limit: int = PENDING_LIMIT, chat_col: str = "sent_to_chat_id",
                    first_window: int = FIRST_WINDOW) -> DataFrame:
    """Newest ``limit`` unsent rows for every chat at once: (chat_id, rank, ...).

    Only a window of the newest rows is ranked, and only the log rows of its
    news are counted (``unsent_ranks``). A chat that has ``limit`` unsent rows
    there is settled; for the others the window grows, up to all rows. Ranks
    start at the newest row, so they are the same in every window. The filter
    on ``fetched_at`` reaches the scan of ``news`` (rows without a time are in
    the last window only); only the news rows that some chat needs fetch their
    texts and source names."""
    known = news.join(sources.select(F.col("id").alias("_sid")), F.col("source_id") == F.col("_sid"), "left_semi")
    ranks, ranked = _pending_ranks(known, news, sent, chats, limit, chat_col, first_window)
    needed = ranked.join(ranks.select("r").distinct(), "r", "left_semi").select(F.col("id").alias("_id"), "r")
    rows = with_source(news.join(needed, F.col("id") == F.col("_id")).drop("_id"), sources)
    return ranks.join(rows, "r").drop("r")


def count_recent(news: DataFrame, now: Column, hours: int = 24,
                 ts_col: str = "fetched_at") -> DataFrame:
    """One row: rows with ``ts >= now - hours`` (inclusive). ``now`` is an
    argument (a literal or a scalar subquery), never the wall clock."""
    return news.filter(F.col(ts_col) >= now - F.make_dt_interval(F.lit(0), F.lit(hours))) \
        .agg(F.count(F.lit(1)).alias("n_recent"))


def status_report(sources: DataFrame, slots: DataFrame, news: DataFrame, now: Column,
                  hours: int = 24, ts_col: str = "fetched_at") -> DataFrame:
    """One row: total and active sources, active slots, recent rows. The
    three aggregates are combined as scalar subqueries (no cross join)."""
    n_slots = slots.agg(F.count_if(F.col("active")).alias("n")).scalar()
    n_recent = count_recent(news, now, hours, ts_col).scalar()
    return sources.agg(F.count(F.lit(1)).alias("n_sources"),
                       F.count_if(F.col("active")).alias("n_active_sources")) \
        .select("n_sources", "n_active_sources",
                n_slots.alias("n_active_slots"), n_recent.alias("n_recent"))


def list_sources(sources: DataFrame, only_active: bool = False) -> DataFrame:
    s = sources.filter(F.col("active")) if only_active else sources
    return s.orderBy("source_type", "id")


def list_slots(slots: DataFrame, only_active: bool = False) -> DataFrame:
    s = slots.filter(F.col("active")) if only_active else slots
    return s.orderBy("hour", "minute")
