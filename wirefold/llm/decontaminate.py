"""Benchmark decontamination by spaced seeds (DataFrame operations only).

Texts become arrays of word hashes. Fixed masks pick some of the positions of
a window and ignore the others; the hash of the picked words is a seed. Seeds
of the benchmark and of every position of every document are joined, and
around each hit the aligned words are compared: an overlap counts if some
window of ``WINDOW`` item words that holds the seed has at least ``RATIO`` of
its words equal. The two masks find every window of 13 words with any two
words substituted (a test tries all placements).

Items shorter than a window are compared whole; their seeds are runs that some
item words must keep whatever words are substituted.

The benchmark is the small side, but its size is checked: it is joined in
blocks of at most ``BLOCK_WORDS`` words, each broadcast. Documents are read in
narrow passes, one per block; only hits are written and aggregated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm.common import broadcast_if_small, stored, table

MASKS = ((0, 2, 3, 6, 7, 9), (0, 1, 2, 4, 6, 7))
WINDOW, RATIO = 13, 0.8
BLOCK_WORDS = 200_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words (runs of letters and digits, lower-cased)."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def needed(words: int, window: int = WINDOW, ratio: float = RATIO) -> int:
    return math.ceil(ratio * min(words, window) - 1e-9)


def run_length(words: int, ratio: float = RATIO) -> int:
    """Words in a row that a short item keeps whatever allowed words are substituted."""
    return max(1, words // (words - needed(words, words, ratio) + 1))


def _seed(hashes: Column, at: Column, mask: tuple[int, ...], number: int) -> Column:
    picked = [F.get(hashes, at + F.lit(o)) for o in mask]
    return F.when(at + F.lit(mask[-1]) < F.size(hashes), F.xxhash64(F.lit(number), *picked))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", masks=MASKS, window: int = WINDOW,
               ratio: float = RATIO, block_words: int = BLOCK_WORDS, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per document (id, and the further ``keys`` of ``docs``) and item
    that overlap: best (most equal words of a window), window (its words),
    first_word and last_word (of the windows found, in words of the document), hits.

    Null and empty texts overlap with nothing, and neither do items without a
    word. Null ids are an id of their own. Repeated documents with one id come
    out once with their hits together. Empty tables give no rows; further
    columns are not read.
    """
    spark = docs.sparkSession
    items = stored(benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col)).alias("item"))
                   .filter(F.size("item") > 0).distinct().withColumn("words", F.size("item"))
                   .withColumn("item_key", F.xxhash64("item_id", "item")), "leak-items")
    words = items.agg(F.sum("words").alias("n")).first()["n"] or 0
    lengths = [r["words"] for r in items.filter(F.col("words") < window).select("words").distinct().collect()]
    # a mask set for items of at least a window, and runs for the lengths below it
    wide = dict(enumerate(masks))
    runs = {1000 + q: tuple(range(q)) for q in sorted({run_length(n, ratio) for n in lengths})}
    all_masks = wide | runs
    blocks = max(1, -(-words // block_words))
    body = docs.select(F.col(id_col).alias("doc_id"), *keys, word_hashes(F.col(text_col)).alias("h"))
    at = F.posexplode("h").alias("pos", "first_hash")
    positions = body.select("doc_id", *keys, "h", at)
    seeds = positions.select("doc_id", *keys, "h", "pos", F.explode(
        F.array(*[_seed(F.col("h"), F.col("pos"), m, i) for i, m in all_masks.items()])).alias("seed"))
    fits = F.lit(False)
    for i in all_masks:
        same = [n for n in lengths if 1000 + run_length(n, ratio) == i]
        fits = fits | ((F.col("mask") == i) & ((F.col("words") >= window) if i in wide else F.col("words").isin(same)))
    hits = None
    for b in range(blocks):
        mine = items.filter(F.pmod("item_key", F.lit(blocks)) == b) if blocks > 1 else items
        placed = mine.select("item_key", "item", "words", F.posexplode("item").alias("item_pos", "w"))
        keyed = placed.select("item_key", "item_pos", "words", F.inline(F.array(*[
            F.struct(F.lit(i).alias("mask"), _seed(F.col("item"), F.col("item_pos"), m, i).alias("seed"))
            for i, m in all_masks.items()])))
        keyed = stored(keyed.filter(F.col("seed").isNotNull() & fits).select("seed", "item_key", "item_pos"), "leak-seeds")
        low = F.greatest(F.col("pos") - F.lit(window - 1), F.lit(0))
        found = (seeds.join(F.broadcast(keyed), "seed")  # at most block_words rows per mask
                 .select("doc_id", *keys, "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos",
                         low.alias("low"), F.slice("h", low + 1, 2 * window - 1).alias("part")))
        hits = found if hits is None else hits.unionAll(found)
    # the part of the document around a hit and the item, aligned
    hits = stored(hits, "leak-hits").join(broadcast_if_small(items, 20_000), "item_key")
    size = F.least(F.col("words"), F.lit(window))
    start_low = F.greatest(F.col("item_pos") - size + 1, F.lit(0))
    start_high = F.least(F.col("item_pos"), F.col("words") - size)
    equal = lambda j: F.when(F.get("part", F.col("shift") + j - F.col("low")) == F.get("item", j), 1).otherwise(0)
    # equal words of the item from start_low to the last word of the last window
    flags = F.transform(F.sequence(start_low, start_high + size - 1), equal)
    sums = F.transform(F.sequence(F.lit(0), start_high - start_low), lambda s: F.struct(
        F.aggregate(F.slice(F.col("flags"), s + 1, F.col("size")), F.lit(0), lambda a, x: a + x).alias("best"),
        (F.col("shift") + start_low + s).alias("begin")))
    need = F.ceil(F.lit(ratio) * F.col("size") - F.lit(1e-9))
    windows = (hits.withColumn("size", size).withColumn("flags", flags)
               .select("doc_id", *keys, "item_id", "size", F.explode(F.filter(sums, lambda x: x["best"] >= need)).alias("x")))
    return windows.groupBy("doc_id", *keys, "item_id").agg(
        F.max("x.best").cast("long").alias("best"), F.max("size").cast("long").alias("window"),
        F.min("x.begin").cast("long").alias("first_word"),
        F.max(F.col("x.begin") + F.col("size") - 1).cast("long").alias("last_word"),
        F.count(F.lit(1)).alias("hits"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap with no benchmark item, with the columns of ``docs``."""
    content = F.xxhash64("text")
    leaks = find_leaks(docs.withColumn("__content", content), table(spark, sf_dir, "benchmark"), keys=("__content",))
    found = stored(leaks.select(F.col("doc_id").alias("__l_id"), F.col("__content").alias("__l_content")).distinct(), "leaks")
    return docs.join(broadcast_if_small(found), F.col("doc_id").eqNullSafe(F.col("__l_id"))
                     & (content == F.col("__l_content")), "left_anti").select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
