import inspect
import re

from pyspark.sql import functions as F

from wirefold.llm import quality
from wirefold.llm.quality import discounts, quality_stage, score_quality


def test_discounts_without_counts(spark):
    assert discounts(spark.createDataFrame([], "code int, n long")) == (0.5, 1.0, 1.5)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_edge_rows(spark, docs_frame, edge_rows):
    labels = labels_of(spark, [(1, 1, 0), (2, 1, None), (3, 1, 0), (None, 1, 0), (7, None, 0), (9, 1, 1), (10, 1, 0), (10, 1, 0)])
    out = score_quality(docs_frame(edge_rows), labels).collect()
    assert len(out) == len(edge_rows)
    for r in out:
        assert (r["__perplexity"] is None) == (not r["text"])
        assert r["__kept"] == (r["__perplexity"] is not None and r["__perplexity"] <= r["__threshold"])
    assert {r["__kept"] for r in out if r["doc_id"] in (3, 4)} == {False}


def test_own_names_of_the_code_do_not_clash(spark, docs_frame):
    labels = labels_of(spark, [(1, 1, 0), (2, 1, 0)])
    rows = [(1, "good text here", "en"), (2, "more good text", "en"), (3, "zzzzqqq", None)]
    plain = {r["doc_id"]: r["__kept"] for r in score_quality(docs_frame(rows), labels).collect()}
    names = set(re.findall(r'"([a-z]+(?:_[a-z]+)*)"', inspect.getsource(quality))) - {"doc_id", "text", "lang"}
    docs = docs_frame(rows).drop(*names)
    for name in names:
        docs = docs.withColumn(name, F.lit("clash"))
    assert {r["doc_id"]: r["__kept"] for r in score_quality(docs, labels).collect()} == plain


def test_nothing_trusted_and_empty(spark, docs_frame, edge_rows):
    none = labels_of(spark, [])
    assert {r["__kept"] for r in score_quality(docs_frame([(1, "abc", "en")]), none).collect()} == {True}
    assert score_quality(docs_frame([]), none).count() == 0


def test_rejects_bad_and_keeps_good(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality_stage(spark, docs, d)
    assert kept.columns == docs.columns
    found = (labels.filter("toxic = 0").join(kept.select("doc_id", F.lit(1).alias("k")), "doc_id", "left")
             .groupBy("quality").agg(F.avg(F.coalesce("k", F.lit(0))).alias("kept")).collect())
    share = {r["quality"]: r["kept"] for r in found}
    assert share[1] >= 0.95 and share[0] <= 0.5, share


def test_most_toxic_rows_do_not_stay_by_chance(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality_stage(spark, docs, d).select("doc_id", F.lit(1).alias("k"))
    share = (labels.filter("toxic = 1 AND quality = 1").join(kept, "doc_id", "left")
             .agg(F.avg(F.coalesce("k", F.lit(0)))).first()[0])
    assert share <= 0.7, share
