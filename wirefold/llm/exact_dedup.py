"""Exact deduplication by a stateful stream (DataFrame operations only).

A narrow digest log (SHA-256 of the normalised text, identifier, byte length,
content locator) is written once and read as a stream. A streaming aggregation
keeps, without watermark or expiry, one state row per digest in the RocksDB
state store, on the executors' disks and checkpointed to the shared folder:
the stable identifier (largest so far), the content locator of that row and
the number of rows. Map-side partial aggregation combines a hot digest before
the shuffle. The finished state is read back with the state data source.

On hits (digests of several rows) the full bytes are compared with those of
the row that stays; large groups are compared in parts of bounded size, so a
group holding a third of all rows is spread over many tasks. Digests whose rows differ are grouped again by the
whole text, so a collision can't merge different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm.common import (BROADCAST_ROWS, LOWER, UPPER, broadcast_if_small, lower_ascii,
                                 pick_rows, scratch, stored, table)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # one cache and write-buffer budget for all state partitions of an executor
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # no space reserved ahead in each of the many small state partitions
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows of a group that are compared with one copy of the kept row's text.
ROWS_PER_PART = 512
#: Log files read by one micro-batch.
FILES_PER_BATCH = 10_000


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _run_state(spark: SparkSession, log_path: str, schema, state_path: str,
               files_per_batch: int) -> DataFrame:
    """Feed the digest log through the keyed state; return the state rows."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        rows = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
                .parquet(log_path))
        state = rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "locator")).alias("keeper"),
            F.count(F.lit(1)).alias("group_size"))
        query = (state.writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", state_path).trigger(availableNow=True).start())
        query.awaitTermination()
        kept = (spark.read.format("statestore").load(state_path)
                .select("key.*", "value.*").toDF("digest", "keeper", "group_size"))
        return stored(kept.filter("group_size > 1")
                      .select("digest", F.col("keeper.doc_id").alias("keep_id"),
                              F.col("keeper.locator").alias("locator"), "group_size"), "dedup-hits")
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise=lower_ascii, digest=sha256_digest, rows_per_part: int = ROWS_PER_PART,
                files_per_batch: int = FILES_PER_BATCH,
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256, locator (its input file), times (rows with its id and text).

    Null texts count as empty. Of equal texts the row with the largest id
    stays (null ids are smaller than any; a group of null ids only has keep_id
    null). Of repeated rows with that id exactly one has ``kept`` true. An
    empty table gives no rows; further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    text = normalise(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"),
                       F.input_file_name().alias("locator"))
    log_path = scratch(spark, "dedup-log")
    log = base.select("doc_id", digest(F.col("norm")).alias("digest"),
                      F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                      F.octet_length("norm").alias("n_bytes"), "locator")
    log.write.option("compression", "zstd").parquet(log_path)
    log = spark.read.schema(log.schema).parquet(log_path)
    hits = _run_state(spark, log_path, log.schema, scratch(spark, "dedup-state"), files_per_batch)

    # rows of digests seen more than once, with the row that stays
    parts = F.ceil(F.col("group_size") / F.lit(rows_per_part)).cast("int").alias("parts")
    members = stored(log.join(broadcast_if_small(hits.select("digest", "keep_id", parts), broadcast_rows),
                              "digest").select("doc_id", "digest", "keep_id", "parts").distinct(), "dedup-members")
    ids = members.select(F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest"), "keep_id", "parts")
    texts = stored(
        base.select("doc_id", "norm", digest(F.col("norm")).alias("digest"))
        .join(broadcast_if_small(ids, broadcast_rows),
              F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest")))
        .select("doc_id", "digest", "keep_id", "parts", "norm"), "dedup-texts")
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), "parts").cast("int"))
    keepers = (texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
               .groupBy("digest", "parts").agg(F.min("norm").alias("kept_norm")).withColumn(
                   "salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    differing = stored(salted.join(keepers, ["digest", "salt"])
                       .filter(F.col("norm") != F.col("kept_norm")).select("digest").distinct(),
                       "dedup-differing")

    joined = log.join(broadcast_if_small(hits.drop("locator"), broadcast_rows), "digest", "left")
    if differing.isEmpty():
        placed = joined
    else:  # a digest that covers several texts: group those rows by the whole text
        regrouped = (texts.join(differing, "digest", "left_semi")
                     .select("doc_id", "digest", "norm"))
        exact = (log.select("doc_id", "digest", "text_sha256").join(differing, "digest", "left_semi")
                 .groupBy("digest", "text_sha256")
                 .agg(F.max("doc_id").alias("x_keep"), F.count(F.lit(1)).alias("x_size")))
        same = regrouped.groupBy("digest", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")) \
            .agg((F.min("norm") == F.max("norm")).alias("one_text"))
        exact = exact.join(same.filter("one_text").drop("one_text"), ["digest", "text_sha256"])
        placed = (joined.join(exact, ["digest", "text_sha256"], "left")
                  .withColumn("group_size", F.coalesce("x_size", "group_size"))
                  .withColumn("keep_id", F.when(F.col("x_size").isNotNull(), F.col("x_keep"))
                              .otherwise(F.col("keep_id"))))
    grouped = F.col("group_size").isNotNull()
    rows = (placed.withColumn("keep_id", F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")))
            .withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
            # equal rows are one line with a count: of them only the first is kept
            .groupBy("doc_id", "text_sha256", "keep_id", "group_size")
            .agg(F.count(F.lit(1)).alias("times"), F.max("locator").alias("locator"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))))
    return rows.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256", "locator", "times")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    result = exact_dedup(docs)
    return pick_rows(docs, result.filter("kept").select("doc_id", "text_sha256", "times"), {
        "doc_id": F.col("doc_id"),
        "text_sha256": F.sha2(lower_ascii(F.col("text")).cast("binary"), 256)})


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
