"""Incremental ingest as a Structured Streaming query.

The keys seen so far live in the stream's state store (RocksDB on the
executors' disks, its changes in the stream's checkpoint): a grouped minimum of
(time of the micro-batch, arrival order, row) per key, without a watermark, so
a key that comes back after any delay is still ignored. An earlier batch has an
earlier time, so the stored row wins; within a batch the first by order does.
The minimum combines map-side, so a hot key is one row per task. A batch reads
its own rows and the state of their keys; it never reads the table.

Rows whose key holds a NULL never clash and pass by the state.

Exactly once: the batch's time is part of the stream's own log, so a replayed
batch gives the same rows, and it writes them to its own ``batch_id=N`` folder
in overwrite mode. The caller names the root folder, which must be one that
all executors share.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_arrivals(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of a stream to insert under a unique key, in update mode: for
    each key that no earlier micro-batch had, the first row by ``order``."""
    now = F.current_timestamp()  # one instant per micro-batch
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    rest = [c for c in stream.columns if c not in keys and c not in order]
    first = (stream.filter(~null_key).withColumn("_seen", now).groupBy(*keys)
             .agg(F.min(F.struct("_seen", *order, *rest)).alias("_first"))
             .filter(F.col("_first._seen") == now))
    named = [F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in stream.columns]
    return first.select(*named).unionByName(stream.filter(null_key))


def write_batch(rows: DataFrame, batch_id: int, table_path: str) -> None:
    """One micro-batch's rows in a folder of their own; a replay replaces it."""
    rows.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")


def stream_ingest(spark: SparkSession, source_dir: str, schema: T.StructType | str, keys: list[str],
                  order: list[str], root: str, glob: str = "*.parquet",
                  max_files_per_trigger: int | None = None, progress: list | None = None) -> str:
    """Run the stream over the parquet files in ``source_dir`` until all
    available files are processed (``availableNow``); return the table's path.
    ``root`` holds the table and the stream's checkpoint, whose state keeps the
    number of shuffle partitions it began with. ``progress`` collects the
    stream's reports of its micro-batches."""
    table_path = f"{root.rstrip('/')}/table"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    with settings(spark, STATE_STORE):
        q = (first_arrivals(reader.parquet(source_dir), keys, order).writeStream
             .outputMode("update")
             .foreachBatch(lambda df, bid: write_batch(df, bid, table_path))
             .option("checkpointLocation", f"{root.rstrip('/')}/checkpoint")
             .trigger(availableNow=True)
             .start())
        q.awaitTermination()
    if progress is not None:
        progress.extend(q.recentProgress)
    return table_path
