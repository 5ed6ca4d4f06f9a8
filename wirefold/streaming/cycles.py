"""Delivery cycles over micro-batches of landed files, on stored tables.

News, summaries, outbox and sent log are append-only tables with a folder per
batch. A cycle reads the folders of earlier batches only and writes its own in
overwrite mode, the sent log last but for the counts; so a batch that was lost between two writes
is run again and gives the same tables, and a delivery that was not logged
comes back in a later cycle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.operators.stored import append_batch, read_batches
from wirefold.plans import cycle as CY

SUMMARIES = T.StructType([T.StructField("id", T.LongType()), T.StructField("summary_tr", T.StringType())])


#: Rows added, pending, held back (near-duplicates, failed enrichment) and logged as sent.
COUNTS = "n_added long, n_pending long, n_removed long, n_sent long"


def all_delivered(outbox: DataFrame) -> DataFrame:
    """Delivery results (news_id, chat_id, ok, message_id) when every send succeeds."""
    return outbox.select("news_id", "chat_id", F.lit(True).alias("ok"), F.lit(None).cast("long").alias("message_id"))


class CycleStore:
    """The stored tables of a flow under one shared folder."""

    def __init__(self, spark: SparkSession, root: str, news: T.StructType, sent: T.StructType):
        self.spark, self.root, self.news_schema, self.sent_schema = spark, root.rstrip("/"), news, sent

    @classmethod
    def create(cls, root: str, news: DataFrame, sent: DataFrame) -> CycleStore:
        store = cls(news.sparkSession, root, news.schema, sent.schema)
        append_batch(news, f"{store.root}/news")
        append_batch(sent, f"{store.root}/sent")
        append_batch(store.spark.createDataFrame([], SUMMARIES), f"{store.root}/summaries")
        return store

    def news(self, before: int | None = None) -> DataFrame:
        """News with the summaries stored for them; a row gets one summary at most."""
        rows = read_batches(self.spark, f"{self.root}/news", self.news_schema, before)
        found = read_batches(self.spark, f"{self.root}/summaries", SUMMARIES, before).withColumnRenamed("summary_tr", "_summary")
        return (rows.join(found, "id", "left").withColumn("summary_tr", F.coalesce("_summary", "summary_tr"))
                .select(*self.news_schema.names))

    def sent(self, before: int | None = None) -> DataFrame:
        return read_batches(self.spark, f"{self.root}/sent", self.sent_schema, before)

    def counts(self) -> DataFrame:
        """One row per cycle (``COUNTS`` and batch_id)."""
        return self.spark.read.parquet(f"{self.root}/counts")

    def outbox(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/outbox")

    def run_cycle(self, batch_id: int, landing: DataFrame, sources: DataFrame, chats: DataFrame, now: Column,
                  deliver: Callable[[DataFrame], DataFrame] = all_delivered, **options) -> None:
        """One cycle (``cycle.news_cycle``) over the tables as the batches
        before ``batch_id`` left them."""
        sent = self.sent(batch_id)
        seen = {name: Observation() for name in ("added", "pending", "rendered", "sent")}
        counted = lambda rows, name: rows.observe(seen[name], F.count(F.lit(1)).alias("n"))
        found = CY.news_cycle(sources, landing, self.news(batch_id), sent, chats, now, count_pending=seen["pending"], **options)
        append_batch(counted(found["new_rows"].select(*self.news_schema.names), "added"), f"{self.root}/news", batch_id)
        append_batch(found["summaries"], f"{self.root}/summaries", batch_id)
        append_batch(counted(found["outbox"], "rendered"), f"{self.root}/outbox", batch_id)
        outbox = self.outbox().filter(F.col("batch_id") == batch_id)
        append_batch(counted(CY.delivered(sent, deliver(outbox)), "sent"), f"{self.root}/sent", batch_id)
        n = {name: o.get["n"] for name, o in seen.items()}  # counted by the jobs that wrote the rows
        append_batch(self.spark.createDataFrame([(n["added"], n["pending"], n["pending"] - n["rendered"], n["sent"])], COUNTS),
                     f"{self.root}/counts", batch_id)


def stream_cycles(store: CycleStore, landing_dir: str, schema: T.StructType, sources: DataFrame, chats: DataFrame,
                  now: Column, glob: str = "*.parquet", files_per_cycle: int | None = 1, **options) -> None:
    """Run a cycle for each ``files_per_cycle`` landed files in ``landing_dir``
    (None: for all that are there), oldest first, until all are processed; a
    later call goes on with the files that came since."""
    reader = (store.spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true"))
    if files_per_cycle is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_cycle)
    stream = reader.parquet(landing_dir)
    q = (stream.writeStream.foreachBatch(lambda df, bid: store.run_cycle(bid, df, sources, chats, now, **options))
         .option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
