"""Explicit schemas of the pipeline tables and the bindings of those roles to
the given test tables (one parquet file each under an ``sf`` folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.operators.ordinal import keyed_ordinal

SOURCES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("url", T.StringType(), True),
    T.StructField("x_handle", T.StringType(), True),
    T.StructField("source_type", T.StringType(), False),
    T.StructField("active", T.BooleanType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

NEWS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("source_id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("published_at", T.StringType(), True),
    T.StructField("fetched_at", T.TimestampType(), False),
    T.StructField("summary_tr", T.StringType(), True),
    T.StructField("is_column", T.BooleanType(), False),
])

SENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("news_id", T.LongType(), False),
    T.StructField("sent_to_chat_id", T.StringType(), False),
    T.StructField("sent_at", T.TimestampType(), False),
    T.StructField("message_id", T.LongType(), True),
])

USER_STATE_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("last_manual_fetch_at", T.TimestampType(), True),
    T.StructField("last_scheduled_fetch_at", T.TimestampType(), True),
    T.StructField("admin", T.BooleanType(), False),
])

SLOTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("hour", T.IntegerType(), False),
    T.StructField("minute", T.IntegerType(), False),
    T.StructField("active", T.BooleanType(), False),
])

SOURCE_TYPES = ["rss", "web", "x"]
DOC_BATCH_ROWS = 50      # rows per dedup batch (the pending-list limit)
DEFAULT_CHAT = "N"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources_large(spark, sf_dir) -> DataFrame:
    """Sources from ``customer``: every order's customer exists."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def sources_small(spark, sf_dir) -> DataFrame:
    """Sources from ``supplier`` with a type by ``s_suppkey % 3`` and an
    active flag by ``s_suppkey % 5 <> 0``."""
    s = table(spark, sf_dir, "supplier")
    stype = F.element_at(F.array(*[F.lit(t) for t in SOURCE_TYPES]),
                         (F.pmod(F.col("s_suppkey"), F.lit(3)) + 1).cast("int"))
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.when(stype != "x", F.concat(F.lit("https://feeds.example.org/"), F.col("s_suppkey").cast("string")))
        .alias("url"),
        F.when(stype == "x", F.concat(F.lit("@"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", ""))))
        .alias("x_handle"),
        stype.alias("source_type"),
        (F.pmod(F.col("s_suppkey"), F.lit(5)) != 0).alias("active"),
        F.col("s_nationkey"), F.col("s_acctbal"))


def news_orders(spark, sf_dir) -> DataFrame:
    """News from ``orders``: id, source, fetch time."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"),
        F.col("o_orderdate").alias("fetched_at"))


def sent_lineitem(spark, sf_dir) -> DataFrame:
    """Sent log from ``lineitem``: chat = return flag; repeated pairs occur."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("news_id"), F.col("l_returnflag").alias("sent_to_chat_id"))


def news_documents(spark, sf_dir, batch_rows: int = DOC_BATCH_ROWS) -> DataFrame:
    """News with text from ``documents``, cut into batches of ``batch_rows``
    per source in ``doc_id`` order: (doc_id, source, text, pos, batch)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang")
    # number the narrow (source, doc_id) pairs only, then bring the text back
    num = keyed_ordinal(d.select("doc_id", "source"), ["source"], ["doc_id"], out="rn")
    d = d.join(num.select("doc_id", "rn"), "doc_id")
    return d.select(
        "doc_id", "source", "text", "lang", F.col("rn").alias("pos"),
        F.concat(F.col("source"), F.lit(":"),
                 F.floor((F.col("rn") - 1) / batch_rows).cast("string")).alias("batch"))
