"""Timelines lie in as many tasks as their text needs."""
from pyspark.sql import functions as F

from wirefold.sources import extract as X


def test_bodies_alike_are_dealt_by_their_text(spark):
    landed = spark.range(40).select(F.col("id").alias("source_id"), F.lit(0).alias("mirror_rank"), F.repeat(F.lit("x"), 1000).alias("body"))
    dealt = X.dealt_bodies(landed, task_chars=4000)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 40
