"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model (``wirefold.llm.ngrams``) is over sequences of six characters of any
script. Its tables grow with the trusted text and stay sharded by n-gram:
counts, continuation counts, discounts and the scores of documents come from
joins of them; nothing of the model goes through the driver, and only its rows of
single symbols (at most one per code point) are broadcast. Each document is scored by the model of trusted text of the other half of identifiers.

A document is rejected when its perplexity exceeds the quantile that trusted
documents of its language have. A text's mean log-probability is taken with
``PRIOR_CHARS`` more characters at the mean of all trusted text, so that a text
of a few words isn't rejected by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm import ngrams
from wirefold.llm.common import broadcast_if_small, stored, table

#: Share of trusted documents of a language that stay.
QUANTILE = 0.97
#: Characters at the mean of trusted text that are added to each text.
PRIOR_CHARS = 50


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts."""
    n = {r["k"]: r["c"] for r in counts.filter("n <= 4").groupBy(F.col("n").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    found = []
    for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
        d = k - (k + 1) * y * b / a if a else 0.5 * k
        found.append(min(max(d, 0.05), k - 0.05))
    return tuple(found)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Identifiers that labels call good and none calls bad or toxic."""
    return (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__t_id"))
            .agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q"),
                 F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"))
            .filter("q = 1 AND t = 0").select("__t_id"))


def cross_scores(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (__t_id, text and others) with lp instead of the text. A hash of
    the identifier deals rows into two halves; each is scored by the model of
    the other half's trusted text, so that no document is judged by a model
    that has read it. If a half has no trusted text, both have one model."""
    side = F.pmod(F.xxhash64("__t_id"), F.lit(2))
    trusted = rows.filter("length(text) > 0").join(ids, "__t_id")
    sides = {r["side"] for r in trusted.select(side.alias("side")).distinct().collect()}
    if len(sides) < 2:
        return ngrams.score(rows, *ngrams.train(trusted, discounts))
    halves = [ngrams.score(rows.filter(side == i), *ngrams.train(trusted.filter(side != i), discounts)) for i in (0, 1)]
    return halves[0].unionAll(halves[1])


def score_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang", prior_chars: float = PRIOR_CHARS) -> DataFrame:
    """Rows of ``docs`` with __perplexity, __threshold and __kept added.

    A document stays if its perplexity is at most its language's threshold:
    the ``quantile`` of trusted documents of that language (null is a language
    of its own; one without trusted documents takes that of all; without any
    trusted document all stay). Null and empty texts have no perplexity and
    don't stay. Repeated rows are judged alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ids = broadcast_if_small(stored(trusted_ids(labels), "trusted"))
    key = F.xxhash64(F.col(text_col))
    slim = docs.select(F.col(id_col).alias("__t_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("__t_lang"),
                       key.alias("__t_key"))
    scores = cross_scores(slim.withColumn("n", F.char_length("text")), ids)
    raw = scores.join(ids, "__t_id").filter("lp IS NOT NULL")
    mean = raw.agg((F.sum("lp") / F.sum("n")).alias("m")).first()["m"]
    weight = prior_chars if mean is not None else 0.0
    perplexity = lambda lp, n: F.exp(-(lp + F.lit(weight * (mean or 0.0))) / (n + F.lit(float(weight))))
    good = raw.select("__t_lang", perplexity(F.col("lp"), F.col("n")).alias("ppl"))
    cut = F.percentile_approx("ppl", quantile, 10_000)
    by_lang = good.groupBy("__t_lang").agg(cut.alias("__cut"))
    overall = good.agg(cut.alias("__cut")).first()["__cut"]
    thresholds = broadcast_if_small(stored(by_lang, "thresholds"))
    # a row's score by identifier and text: repeated rows have one score
    once = stored(scores.groupBy(F.col("__t_id").alias("__s_id"), F.col("__t_key").alias("__s_key"))
                  .agg(F.first("lp").alias("__s_lp")), "scores")
    scored = (docs.join(broadcast_if_small(once), F.col(id_col).eqNullSafe(F.col("__s_id")) & (key == F.col("__s_key")), "left")
              .withColumn("__perplexity", perplexity(F.col("__s_lp"), F.char_length(text_col))).drop("__s_id", "__s_key", "__s_lp"))
    joined = scored.join(thresholds, F.col(lang_col).eqNullSafe(F.col("__t_lang")), "left")
    limit = F.coalesce(F.col("__cut"), F.lit(overall).cast("double"), F.lit(float("inf")))
    return (joined.withColumn("__threshold", limit)
            .withColumn("__kept", F.coalesce(F.col("__perplexity") <= F.col("__threshold"), F.lit(False)))
            .drop("__t_lang", "__cut"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    return score_quality(docs, table(spark, sf_dir, "labels")).filter("__kept").select(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "lang", F.col("__perplexity").alias("perplexity"), F.col("__threshold").alias("threshold"),
        F.col("__kept").alias("kept"))
