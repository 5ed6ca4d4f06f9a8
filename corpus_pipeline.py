"""A corpus pipeline over ``documents``: each stage calls one operator of
``wirefold.llm``, is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirefold.llm import decontaminate, exact_dedup, packing, quality, simhash
from wirefold.llm.common import scratch, table

STAGES = [
    ("quality", quality.quality_stage),
    ("exact_dedup", exact_dedup.dedup_stage),
    ("simhash", simhash.simhash_stage),
    ("decontaminate", decontaminate.decontaminate_stage),
    ("packing", packing.packing_stage),
]

#: The stages learn models, run streams and call a tokeniser: no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
