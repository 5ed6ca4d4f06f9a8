"""TF-IDF weighting and similar-pair search, keyed by a batch column.

Input is a frame of items with a batch key, a position (arrival order inside
the batch) and the text. Everything is computed per batch, so many batches
run side by side; the IDF and vocabulary of a batch never leak into another
(similarity of two rows depends on their neighbours).

Weights follow the classic smoothed TF-IDF: raw term count times
``ln((1 + n) / (1 + df)) + 1``, vocabulary cut to the ``max_features`` terms
with the largest total count (ties: term ascending), then L2-normalised per
row, so cosine similarity is a plain dot product.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions import text as T
from wirefold.session import cut_lineage, stored

# Fixed values of the duplicate filter being matched.
SIMILARITY_THRESHOLD = 0.75
MAX_FEATURES = 5000
NGRAM_MAX = 2
#: Rounding that a bound may be off by.
SLACK = 1e-9


def corpus(items: DataFrame, batch: str = "batch", pos: str = "pos",
           title: str | None = "title", content: str | None = "content") -> DataFrame:
    """(batch, pos, norm): the normalised 'title content' text of each row."""
    t = F.col(title) if title else F.lit(None).cast("string")
    c = F.col(content) if content else F.lit(None).cast("string")
    return items.select(F.col(batch).alias("batch"), F.col(pos).alias("pos"),
                        T.corpus_text(t, c).alias("norm"))


#: Characters of text that one task takes, and the largest batch that lies whole in one task.
TASK_CHARS, BATCH_CHARS = 4_000_000, 8_000_000


class Dealt(NamedTuple):
    """Non-blank rows dealt to tasks by the columns ``by``: by batch, so that
    whatever is grouped by batch and more stays in its task, or by batch and
    pos. ``unique``: no (batch, pos) comes twice. ``rows``: of the largest batch."""
    docs: DataFrame
    by: list[str]
    tasks: int
    unique: bool
    rows: int
    chars: int

    @property
    def whole(self) -> bool:
        return self.by == ["batch"]

    def deal(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.tasks, *self.by)


def dealt(docs: DataFrame, task_chars: int = TASK_CHARS, batch_chars: int = BATCH_CHARS) -> Dealt:
    """The non-blank rows of ``docs`` (batch, pos, norm and further columns)
    in as many tasks as their text needs, row by row if a batch is larger than
    ``batch_chars``. Read twice: give a written frame."""
    per_row = docs.groupBy("batch", "pos").agg(F.sum(F.length("norm")).alias("chars"), F.count(F.lit(1)).alias("n"))
    found = (per_row.groupBy("batch").agg(F.sum("chars").alias("chars"), F.max("n").alias("n"), F.sum("n").alias("rows"))
             .agg(F.sum("chars").alias("chars"), F.max("chars").alias("largest"), F.max("n").alias("n"), F.max("rows").alias("rows")).first())
    tasks = max(shuffle_parts(docs), -(-(found["chars"] or 0) // task_chars))
    by = ["batch"] if (found["largest"] or 0) <= batch_chars else ["batch", "pos"]
    return Dealt(docs.filter(F.col("norm") != "").repartition(tasks, *by), by, tasks, (found["n"] or 0) <= 1, found["rows"] or 0,
                 found["chars"] or 0)


def term_freq(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, batch, pos, term, tf): raw count of each term in each non-blank
    row, counted where the rows lie if they are ``dealt``. ``keep``: further
    columns, which follow from (batch, pos)."""
    # tokens are a column of their own: the n-grams read them several times
    return (docs.filter(F.col("norm") != "")
            .select(*keep, "batch", "pos", T.tokens(F.col("norm")).alias("toks"))
            .select(*keep, "batch", "pos", F.explode(T.ngram_terms(F.col("toks"))).alias("term"))
            .groupBy(*keep, "batch", "pos", "term").agg(F.count(F.lit(1)).alias("tf")))


def doc_freq(tf: DataFrame) -> DataFrame:
    """(batch, term, df, total): rows holding the term, and its total count."""
    return tf.groupBy("batch", "term").agg(F.count(F.lit(1)).alias("df"),
                                           F.sum("tf").alias("total"))


def shuffle_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions: what fixed splits follow."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Terms of a batch that one task may sort.
TERMS_PER_SORT = 200_000


def vocabulary(dfs: DataFrame, max_features: int | None = MAX_FEATURES, terms_per_sort: int = TERMS_PER_SORT,
               whole: bool = False) -> DataFrame:
    """Top ``max_features`` terms per batch by total count, ties by term.

    Two exact phases, so one huge batch never sorts all its terms in one
    task: first a top-k per (batch, part), the parts of a batch following from
    its number of terms, then a top-k per batch over the survivors (the global
    top k is inside the union of the parts' top k). A batch of few terms has
    one part, which already cuts it to k. Spark's own WindowGroupLimit only
    kicks in for k up to 1000, which the 5,000-term cap exceeds. Batches that lie
    ``whole`` in tasks (``dealt``) are sorted there, and nothing is written."""
    order = [F.col("total").desc(), F.col("term").asc()]
    if whole:
        # a null batch has no vocabulary, here as in the join below
        ranked = (dfs.filter(F.col("batch").isNotNull())
                  .withColumn("vrank", F.row_number().over(Window.partitionBy("batch").orderBy(*order))))
        return ranked if max_features is None else ranked.filter(F.col("vrank") <= max_features)
    dfs = cut_lineage(dfs)
    parts = dfs.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / F.lit(terms_per_sort)).alias("_parts"))
    split = dfs.join(parts, "batch").withColumn("_part", F.pmod(F.xxhash64("term"), F.col("_parts"))).drop("_parts")
    w1 = Window.partitionBy("batch", "_part").orderBy(*order)
    part = split.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= max_features)
    w2 = Window.partitionBy("batch").orderBy(*order)
    return (part.drop("_part", "_r").withColumn("vrank", F.row_number().over(w2))
            .filter(F.col("vrank") <= max_features))


def valid_counts(docs: DataFrame) -> DataFrame:
    """(batch, n_valid): non-blank rows per batch (n of the IDF)."""
    return docs.filter(F.col("norm") != "").groupBy("batch").agg(F.count(F.lit(1)).alias("n_valid"))


def smoothed_idf() -> Column:
    """One more than MLlib's."""
    return F.log((F.lit(1.0) + F.col("n_valid")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)


def idf(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """(batch, term, df, idf) with the smoothed formula."""
    return vocab.join(counts, "batch").select("batch", "term", "df", smoothed_idf().alias("idf"))


def tfidf_rows(d: Dealt, max_features: int | None = MAX_FEATURES, names: bool = True) -> DataFrame:
    """(batch, pos, terms, dfs, ws, len): of each row with a vocabulary term
    its terms, their df and weights before the division by ``len``, the L2 norm."""
    number = F.col("term") if names else F.col("number")
    counts = valid_counts(d.docs)
    if d.whole:
        # by windows, which keep a batch in its task (a join by batch and term would deal the terms anew)
        of_term = Window.partitionBy("batch", "term")
        known = (term_freq(d.docs).filter(F.col("batch").isNotNull())
                 .withColumn("df", F.count(F.lit(1)).over(of_term)).withColumn("total", F.sum("tf").over(of_term))
                 .withColumn("number", F.dense_rank().over(Window.partitionBy("batch").orderBy(F.col("total").desc(), "term")).cast("long")))
        if max_features is not None:
            known = known.filter(F.col("number") <= max_features)
        known = known.join(counts, "batch").withColumn("idf", smoothed_idf())
    else:
        tf = term_freq(d.docs)
        dfs = doc_freq(tf)
        vocab = idf(dfs if max_features is None else vocabulary(dfs, max_features), counts)
        if not names:  # numbered in a written table: the numbers stay
            vocab = cut_lineage(vocab.withColumn("number", F.monotonically_increasing_id()))
        known = tf.join(vocab, ["batch", "term"])
    if d.whole:  # a batch of bounded text: its numbers fit into four bytes
        known, number = known.withColumn("df", F.col("df").cast("int")), number if names else number.cast("int")
    raw = known.select("batch", "pos", number.alias("term"), "df", (F.col("tf") * F.col("idf")).alias("w"))
    rows = raw.groupBy("batch", "pos").agg(F.collect_list(F.struct("term", "df", "w")).alias("x"),
                                           F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return rows.select("batch", "pos", F.col("x.term").alias("terms"), F.col("x.df").alias("dfs"), F.col("x.w").alias("ws"), "len")


def _numbered(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, rising (null last), and each value's place among them."""
    found = values.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(found.dictionary)
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return found.dictionary.take(order), place[found.indices.to_numpy()]


def _weigh_batch(max_features: int | None):
    def weigh(batch: pa.Table, members: pa.Table | None = None) -> pa.Table:
        # rows of one position are one row, in which each text's terms are counted
        pos, row = _numbered(batch.column("pos").combine_chunks())
        near = np.ones(len(pos), dtype=bool) if members is None else pc.is_in(pos, members.column("near").combine_chunks()).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(batch.column("norm").combine_chunks(), " ")
        long = pc.greater_equal(pc.utf8_length(words.flatten()), 2)
        doc = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())[long.to_numpy(zero_copy_only=False)]
        vocabulary, word = _numbered(words.flatten().filter(long))
        # a term's key: its first word and its second one, if any. Words hold nothing that sorts
        # before the space, so keys rise as the terms do
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        base = len(vocabulary) + 1
        keys, key = np.unique(np.r_[(word + 1) * base, (word[pair] + 1) * base + word[pair + 1] + 1], return_inverse=True)
        cell, tf = np.unique(row[np.r_[doc, doc[pair]]] * max(1, len(keys)) + key, return_counts=True)
        row, term = np.divmod(cell, max(1, len(keys)))
        df = np.bincount(term, minlength=len(keys))
        ranked = np.lexsort((np.arange(len(keys)), -np.bincount(term, tf, len(keys))))[:max_features]
        rank = np.full(len(keys), -1)
        rank[ranked] = np.arange(len(ranked))
        known = rank[term] >= 0
        row, term, tf = row[known], rank[term[known]], tf[known]
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][:len(row)])
        used = row[begins]
        cell = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        one = batch.column("batch").slice(0, 1).combine_chunks() if len(batch) else pa.nulls(1, batch.schema.field("batch").type)
        return pa.table({"batch": one, "n_valid": pa.array([len(batch)], pa.int64()),
                         "pos": cell(pos.take(pa.array(used)), pos.type), "member": cell(near[used], pa.bool_()),
                         "ends": cell(np.r_[begins, len(row)][1:], pa.int32()), "terms": cell(term, pa.int32()), "tfs": cell(tf, pa.int32()),
                         "dfs": cell(df[ranked], pa.int32())}).slice(0, min(1, len(batch)))
    return weigh


def tfidf_batches(d: Dealt, max_features: int | None = MAX_FEATURES, members: DataFrame | None = None) -> DataFrame:
    """The weights of ``tfidf`` for batches that lie whole in tasks, one row per
    batch: (batch, n_valid, pos, member, ends, terms, tfs, dfs). ``pos`` are the
    rows with a vocabulary term, rising, ``ends`` where each one's entries of
    ``terms`` (numbers by rank) and ``tfs`` end; ``dfs`` is the df by number. ``member``
    tells which rows are among ``members`` (batch, pos), all if not given.

    A text is exchanged once and its terms never are: they are counted, ranked
    and cut where the batch lies. An entry takes about two bytes when written."""
    docs = d.docs.filter(F.col("batch").isNotNull()).select("batch", "pos", "norm")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = (f"batch {kinds['batch']}, n_valid long, pos array<{kinds['pos']}>, member array<boolean>, "
              "ends array<int>, terms array<int>, tfs array<int>, dfs array<int>")
    grouped, weigh = docs.groupBy("batch"), _weigh_batch(max_features)
    if members is None:
        return grouped.applyInArrow(lambda batch: weigh(batch), schema)
    near = d.deal(members.select("batch", "pos")).select(F.col("batch").alias("of"), F.col("pos").alias("near"))
    return grouped.cogroup(near.groupBy("of")).applyInArrow(lambda batch, members: weigh(batch, members), schema)


def tfidf(docs: DataFrame, max_features: int | None = MAX_FEATURES, names: bool = True, d: Dealt | None = None,
          packed: bool = False, members: DataFrame | None = None) -> DataFrame:
    """(batch, pos, term, df, weight): L2-normalised TF-IDF of each row, over
    the batch's ``max_features`` most frequent terms, or over all its terms
    (None). Rows with no vocabulary term have no rows here. Without ``names``
    a term is a number of its own in its batch instead of its text, so that
    later joins carry eight bytes.

    Written as one row of arrays per document, a third of the bytes of a row
    per term, and dealt again like ``docs`` (``d``, if they are dealt already):
    what later steps group or join by batch stays in its task if the batches
    are small. ``packed``: ``tfidf_batches`` (of batches that lie whole in tasks,
    ``members`` marked) instead, not written."""
    if packed:
        return tfidf_batches(d, max_features, members)
    d = d or dealt(cut_lineage(docs.select("batch", "pos", "norm")))
    rows = d.deal(cut_lineage(tfidf_rows(d, max_features, names)))
    x = F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"), F.col("ws").alias("w"))
    return (rows.select("batch", "pos", "len", F.explode(x).alias("x"))
            .select("batch", "pos", (F.col("x.term") if names else F.col("x.term").cast("long")).alias("term"),
                    F.col("x.df").cast("long").alias("df"), (F.col("x.w") / F.col("len")).alias("weight")))


def prefix_terms(weights: DataFrame, threshold: float, d: Dealt | None = None) -> DataFrame:
    """Index terms of the all-pairs prefix filter.

    Terms of a row are put in one order shared by the whole batch (rising df,
    then term). A term is indexed while an upper bound of what the row's
    remaining terms (itself included) can add to any dot product is still
    >= threshold. Two bounds hold, and the smaller is used: the L2 norm of the
    remaining weights (Cauchy-Schwarz against a unit row), and the sum of
    ``weight * maxweight(term)`` over them (no row holds a term with more than
    its batch maximum). Two rows that share no indexed term then have cosine
    below the threshold, so joining on indexed terms finds every pair at or
    above it, exactly; frequent terms, whose weights are small everywhere, are
    rarely indexed, which keeps the candidate join far from quadratic. ``d``:
    how ``weights`` were dealt.
    """
    if d is not None and d.whole:
        bounded = weights.withColumn("maxw", F.max("weight").over(Window.partitionBy("batch", "term")))
    else:
        bounded = weights.join(weights.groupBy("batch", "term").agg(F.max("weight").alias("maxw")), ["batch", "term"])
    row = Window.partitionBy("batch", "pos")
    w = (row.orderBy(F.col("df").desc(), F.col("term").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest_l2 = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w))
    rest_mw = F.sum(F.col("weight") * F.col("maxw")).over(w)
    # small slack so rounding never drops a needed candidate
    indexed = F.col("bound") >= F.lit(threshold - SLACK)
    return (bounded.withColumn("bound", F.least(rest_l2, rest_mw))
            .withColumn("rest", F.coalesce(F.max(F.when(~indexed, F.col("bound"))).over(row), F.lit(0.0)))
            .filter(indexed).select("batch", "pos", "term", "weight", "rest"))


def candidates(first: DataFrame, later: DataFrame, threshold: float) -> DataFrame:
    """(batch, i, j): pairs i < j of rows of two indexes (``prefix_terms``)
    that share an indexed term and whose cosine can reach the threshold: what
    their indexed terms give, and at most the larger ``rest`` of the two. (Of
    the two rows, take the one whose index ends earlier in the common order of
    terms. Whatever they share beyond its index is in its own rest.)"""
    a = first.select("batch", F.col("pos").alias("i"), "term", F.col("weight").alias("wi"), F.col("rest").alias("ri"))
    b = later.select("batch", F.col("pos").alias("j"), "term", F.col("weight").alias("wj"), F.col("rest").alias("rj"))
    return (a.join(b, ["batch", "term"]).filter(F.col("i") < F.col("j"))
            .groupBy("batch", "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("part"),
                                            F.max(F.greatest("ri", "rj")).alias("rest"))
            .filter(F.col("part") + F.col("rest") >= F.lit(threshold - SLACK)).select("batch", "i", "j"))


def _by_batch(df: DataFrame, d: Dealt | None) -> DataFrame:
    """``df`` dealt like the weights if their batches lie whole in tasks."""
    return d.deal(df) if d is not None and d.whole else df


def verified(cand: DataFrame, weights: DataFrame, threshold: float, d: Dealt | None = None) -> DataFrame:
    """(batch, i, j, sim) of the candidates with cosine >= threshold, by exact
    dot products; only rows of some candidate bring their weights. ``d``: how
    ``weights`` were dealt. ``weights`` may be ``shared_rows``."""
    if "ws" in weights.columns:
        return _verified_rows(cand, weights, threshold)
    cand = _by_batch(cand, d)
    used = (cand.select("batch", F.col("i").alias("pos")).unionByName(cand.select("batch", F.col("j").alias("pos")))
            .distinct())
    near = weights.join(used, ["batch", "pos"], "left_semi")
    wi = near.select("batch", F.col("pos").alias("i"), "term", F.col("weight").alias("wi"))
    wj = near.select("batch", F.col("pos").alias("j"), "term", F.col("weight").alias("wj"))
    dots = (cand.join(wi, ["batch", "i"])
            .join(wj, ["batch", "j", "term"])
            .groupBy("batch", "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("sim")))
    return dots.filter(F.col("sim") >= F.lit(threshold))


#: Numbers of a block of weights by term that a batch is compared with, and of the products made at once.
BLOCK_CELLS, PRODUCT_CELLS = 8_000_000, 2_000_000


def _dots(row: np.ndarray, term: np.ndarray, w: np.ndarray, threshold: float):
    """(i, j, sim) of the pairs i < j of rows with a dot product >= ``threshold``,
    for entries sorted by row: a block of rows is laid out by term, and the
    rows from there on take what their terms have in it."""
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][:len(row)])
    of, (_, term) = row[begins], np.unique(term, return_inverse=True)
    ends = np.r_[begins, len(row)]
    size = term.max(initial=0) + 1
    step = max(1, BLOCK_CELLS // size)
    for a in range(0, len(of), step):
        b = min(a + step, len(of))
        block = np.zeros((size, b - a))
        mine = slice(ends[a], ends[b])
        block[term[mine], np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))] = w[mine]
        most = max(1, PRODUCT_CELLS // (b - a))
        k = a
        while k < len(of):
            n = max(k + 1, int(np.searchsorted(ends, ends[k] + most, "right")) - 1)
            part = slice(ends[k], ends[n])
            sims = np.add.reduceat(block[term[part]] * w[part, None], ends[k:n] - ends[k], axis=0)
            j, i = np.nonzero(sims >= threshold)
            later = i + a < j + k
            yield of[i[later] + a], of[j[later] + k], sims[j[later], i[later]]
            k = n


def _pairs_of_batches(threshold: float):
    def pairs(batches):
        for rows in batches:
            for n in range(len(rows)):
                valid, ends, terms, tfs, dfs, near = (rows.column(c)[n].as_py() if c == "n_valid" else rows.column(c)[n].values.to_numpy(zero_copy_only=False)
                                                      for c in ("n_valid", "ends", "terms", "tfs", "dfs", "member"))
                if near.sum() < 2:
                    continue
                pos = rows.column("pos")[n].values
                near = near & pos.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                w = tfs * (np.log((1.0 + valid) / (1.0 + dfs)) + 1.0)[terms]
                w /= np.sqrt(np.bincount(row, w * w, len(ends)))[row]
                kept = near[row]
                kept &= (np.bincount(terms[kept], minlength=len(dfs)) > 1)[terms]  # of one row: in no dot product
                for i, j, sim in _dots(row[kept], terms[kept], w[kept], threshold):
                    yield pa.RecordBatch.from_arrays([pa.array([rows.column("batch")[n].as_py()] * len(i), rows.schema.field("batch").type),
                                                      pos.take(pa.array(i)), pos.take(pa.array(j)), pa.array(sim)], names=["batch", "i", "j", "sim"])
    return pairs


def similar_pairs(weights: DataFrame, threshold: float = SIMILARITY_THRESHOLD,
                  members: DataFrame | None = None, d: Dealt | None = None) -> DataFrame:
    """(batch, i, j, sim) for i < j in one batch with cosine >= threshold
    (inclusive). ``members`` (batch, pos) limits the search to those rows.
    ``d`` tells how ``weights`` were dealt: whole batches are indexed and
    paired in their task, and no index is written.

    One exact plan for every size: candidates share an indexed term of the
    prefix filter, and only rows that are in some candidate bring their
    weights to the dot products. ``weights`` is read several times: give a
    written frame (``tfidf`` does). Of ``tfidf_batches``, which have their
    members marked, each batch is compared where its row lies."""
    if "tfs" in weights.columns:
        kinds = {f.name: f.dataType for f in weights.schema.fields}
        batch, pos = kinds["batch"].simpleString(), kinds["pos"].elementType.simpleString()
        return weights.mapInArrow(_pairs_of_batches(threshold), f"batch {batch}, i {pos}, j {pos}, sim double")
    if members is not None:
        weights = weights.join(_by_batch(members.select("batch", "pos"), d), ["batch", "pos"], "left_semi")
    idx = prefix_terms(weights, threshold, d)
    if d is None or not d.whole:
        idx = cut_lineage(idx)
    return verified(cut_lineage(candidates(idx, idx, threshold)), weights, threshold, d)


#: Hyperplane signatures: bands, and bits of a band.
BANDS, BAND_BITS = 64, 12


def band_keys(terms: np.ndarray, weights: np.ndarray, bands: int, bits: int, seed: int) -> np.ndarray:
    """A row's entry in each band, from the hashes and weights of its terms."""
    words = -(-bands * bits // 64)
    plane = (np.arange(1, words + 1, dtype=np.uint64) + np.uint64(seed * words)) * np.uint64(0x9E3779B97F4A7C15)
    z = terms.view(np.uint64)[:, None] ^ plane[None, :]
    # the mixing steps of splitmix64
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    sides = np.unpackbits(z.view(np.uint8), axis=1)[:, :bands * bits]
    above = 2.0 * (weights @ sides) > weights.sum()
    band = above.reshape(bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return band | np.arange(bands, dtype=np.int64) << 32


def hyperplane_index(weights: DataFrame, bands: int = BANDS, bits: int = BAND_BITS, seed: int = 0) -> DataFrame:
    """An index in place of ``prefix_terms`` that misses some pairs: the
    signature of a row tells on which side of ``bands x bits`` random
    hyperplanes its vector lies (the signs come from a hash of term and
    plane), and rows that agree in a band share an entry. Two rows of cosine c
    agree in a plane with probability 1 - arccos(c) / pi, so of pairs at 0.75
    about 94 % share a band of 12 bits among 64, of unrelated pairs 1.6 %.
    Give more bits for many millions of rows. Terms must be texts, so that a
    row has the same signature in every run."""
    def sign(batches):
        for batch in batches:
            keys = [band_keys(terms.values.to_numpy(), values.values.to_numpy(), bands, bits, seed)
                    for terms, values in zip(batch.column("terms"), batch.column("values"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("batch"), batch.column("pos"), pa.array(keys, pa.list_(pa.int64()))], names=["batch", "pos", "keys"])

    rows = (weights.groupBy("batch", "pos").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("weight").alias("v"))).alias("x"))
            .select("batch", "pos", F.col("x.t").alias("terms"), F.col("x.v").alias("values")))
    kinds = {f.name: f.dataType.simpleString() for f in weights.schema.fields}
    signed = rows.mapInArrow(sign, f"batch {kinds['batch']}, pos {kinds['pos']}, keys array<long>")
    # an entry says nothing of the cosine, so the bound of ``candidates`` lets every pair pass
    return signed.select("batch", "pos", F.explode("keys").alias("term"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("rest"))


def similar_pairs_lsh(weights: DataFrame, threshold: float = SIMILARITY_THRESHOLD, bands: int = BANDS,
                      bits: int = BAND_BITS, seed: int = 0) -> DataFrame:
    """``similar_pairs`` with candidates from ``hyperplane_index``: every pair
    found is exact, some are missed. ``weights`` with term texts, written."""
    idx = cut_lineage(hyperplane_index(weights, bands, bits, seed))
    return verified(cut_lineage(candidates(idx, idx, threshold)), weights, threshold)


#: Characters of a group of texts: each group asks once for each of its distinct terms.
GROUP_CHARS = 6_000_000


class GroupTerms:
    """The terms of a group of texts by hash (64 and 16 bits, of batch and
    term): ``a``, ``b`` of each distinct term, rising; ``df`` and ``texts``, its
    rows and texts in the group; ``term``, ``doc``, ``tf`` of each term of each text.
    The last entry of a text's arrays is the empty term, which every row of
    its batch has: its df is the number of rows."""

    def __init__(self, group: pa.Table):
        a, b = (group.column(c).combine_chunks() for c in ("a", "b"))
        ends = np.cumsum(np.diff(a.offsets.to_numpy()))
        # four bytes a number, as a worker holds a dozen of them for each term of its texts
        doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(np.r_[0, ends]))
        a, b = a.flatten().to_numpy(), b.flatten().to_numpy()
        order = np.lexsort((b, a)).astype(np.int32)  # stable: the entries of a term stay in the order of texts
        a, b, doc = a[order], b[order], doc[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        pair = np.flatnonzero(np.r_[True, fresh[1:] | (doc[1:] != doc[:-1])]).astype(np.int32)
        place = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        self.a, self.b = a[fresh], b[fresh]
        self.term, self.doc, self.tf = place[pair], doc[pair], np.diff(np.r_[pair, np.int32(len(doc))])
        self.entry = order[pair]
        n = group.column("n").to_numpy()
        self.df = np.bincount(self.term, n[self.doc], len(self.a)).astype(np.int64)
        self.texts = np.bincount(self.term, minlength=len(self.a))
        rows = np.empty(len(order), dtype=np.int32)
        rows[order] = place
        self.rows_term = rows[ends - 1]  # the empty term of each text


def _cell(x: np.ndarray, kind: str, rising: bool = False) -> bytes:
    """Numbers byte by byte, the lowest of all first: the high ones, mostly alike,
    then vanish in what is sent compressed. ``rising``: as steps."""
    x = x.astype(kind)
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _numbers(cell: bytes, kind: str, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    x = np.frombuffer(cell, np.uint8).reshape(size, len(cell) // size)
    x = np.ascontiguousarray(x.T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def _packed(terms: np.ndarray, ws: np.ndarray) -> bytes:
    """A row's terms and weights for ``_unpacked``. In the order of ``prefix_terms`` the
    terms of one df follow each other, rising and mostly of one weight."""
    return pa.compress(_cell(terms, "<i8", True) + _cell(ws, "<f8"), "zstd", asbytes=True) if len(terms) else b""


def _unpacked(vector: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(vector, 16 * size, "zstd", asbytes=True) if size else b""
    return _numbers(raw[:8 * size], "<i8", True), _numbers(raw[8 * size:], "<f8")


def _ask(parts: int):
    def ask(group: pa.Table) -> pa.Table:
        g = GroupTerms(group)
        # parts are ranges of a, so a part's terms are a run of the group's
        cuts = np.searchsorted(g.a, np.array([-(1 << 63) + (k << 64) // parts for k in range(1, parts)], dtype=np.int64))
        runs = [(k, i, j) for k, (i, j) in enumerate(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(g.a)].tolist(), strict=True)) if j > i]
        cell = lambda x, *kind: pa.array([_cell(x[i:j], *kind) for _, i, j in runs], pa.binary())
        return pa.table([pa.array([group.column("grp")[0].as_py()] * len(runs), pa.int32()), pa.array([k for k, _, _ in runs], pa.int32()),
                         pa.array([i for _, i, _ in runs], pa.int32()), cell(g.a, "<i8", True), cell(g.b, "<i2"), cell(g.df, "<i8"),
                         cell(np.minimum(g.texts, 2), "u1")], names=["grp", "part", "start", "a", "b", "df", "texts"])
    return ask


def _answer(part: pa.Table) -> pa.Table:
    whole = lambda c, *kind: np.concatenate([_numbers(x, *kind) for x in part.column(c).to_pylist()])
    a, b, df, texts = whole("a", "<i8", True), whole("b", "<i2"), whole("df", "<i8"), whole("texts", "u1")
    sizes = np.array([len(x) // 8 for x in part.column("a").to_pylist()])
    begins = np.r_[0, np.cumsum(sizes)]
    at = np.arange(len(a)) - np.repeat(begins[:-1] - part.column("start").to_numpy(), sizes)
    order = np.lexsort((b, a))
    fresh = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    number = np.empty(len(a), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    all_df, all_texts = np.bincount(number, df), np.bincount(number, texts)
    shared = all_texts[number] > 1
    rows = [np.flatnonzero(shared[i:j]) + i for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    cell = lambda x, *kind: pa.array([_cell(x[r], *kind) for r in rows], pa.binary())
    return pa.table([part.column("grp"), part.column("part"), cell(at, "<i4", True), cell(number, "<i4", True), cell(all_df[number], "<i8")],
                    names=["grp", "part", "at", "number", "df"])


def _weigh(threshold: float, bands: int, bits: int, seed: int):
    def weigh(group: pa.Table, answers: pa.Table) -> pa.Table:
        g, size = GroupTerms(group), group.num_rows
        df, number, shared = g.df.astype(np.float64), np.zeros(len(g.a), dtype=np.int64), np.zeros(len(g.a), dtype=bool)
        for part, at, of, n in zip(*(answers.column(c).to_pylist() for c in ("part", "at", "number", "df")), strict=True):
            at = _numbers(at, "<i4", True)
            shared[at], number[at], df[at] = True, _numbers(of, "<i4", True).astype(np.int64) | part << 32, _numbers(n, "<i8")
        valid = df[g.rows_term]
        real = g.term != g.rows_term[g.doc]
        doc, term, tf, entry = g.doc[real], g.term[real], g.tf[real], g.entry[real]
        w = tf * (np.log((1.0 + valid[doc]) / (1.0 + df[term])) + 1.0)
        length = np.sqrt(np.bincount(doc, w * w, size))
        w /= length[doc]
        keys = None
        if bands:
            hashes, by = group.column("s").combine_chunks().flatten().to_numpy(), np.argsort(doc, kind="stable")
            of = np.split(by, np.cumsum(np.bincount(doc, minlength=size))[:-1])
            keys = [band_keys(hashes[entry[r]], w[r], bands, bits, seed) if len(r) else None for r in of]
        # a row's terms that no other text has are in no dot product; the others in one order for all rows
        mine = shared[term]
        doc, term, w = doc[mine], term[mine], w[mine]
        order = np.lexsort((number[term], df[term], doc))
        doc, term, w = doc[order], term[order], w[order]
        ends = np.cumsum(np.bincount(doc, minlength=size))
        left = np.r_[np.cumsum((w * w)[::-1])[::-1], 0.0]
        # L2 norm of a term and those behind it; what rounding took from the sums is less than what is added
        rest = np.sqrt(np.maximum(left[:-1] - left[ends[doc]], 0.0) + SLACK)
        indexed = rest >= threshold - SLACK
        n_index = np.bincount(doc, indexed, size).astype(np.int64)
        begins = np.r_[0, ends[:-1]]
        behind = np.where(n_index < ends - begins, np.r_[rest, 0.0][np.minimum(begins + n_index, len(rest))], 0.0)
        used = n_index > 0  # the others are near none
        keep = used[doc]
        offsets = pa.array(np.r_[0, np.cumsum(np.where(used, n_index, 0))], pa.int32())
        cell = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x[keep & indexed]))
        sizes = np.where(used, ends - begins, 0)
        vectors = [_packed(number[term[i:i + n]], w[i:i + n]) for i, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
        out = {"batch": group.column("batch"), "pos": group.column("pos"), "terms": cell(number[term]), "ws": cell(w),
               "n_index": pa.array(n_index.astype(np.int32)), "rest": pa.array(behind), "size": pa.array(sizes.astype(np.int32)),
               "vector": pa.array(vectors, pa.binary())}
        if bands:
            out["keys"] = pa.array([k if u else None for k, u in zip(keys, used.tolist(), strict=True)], pa.list_(pa.int64()))
        return pa.table(out).filter(pa.array(length > 0))
    return weigh


def shared_rows(texts: DataFrame, chars: int, threshold: float = SIMILARITY_THRESHOLD, signed: bool = False,
                group_chars: int = GROUP_CHARS, seed: int = 0) -> DataFrame:
    """(batch, pos, terms, ws, n_index, rest, size, vector): weights over all terms of batches
    of any size, for ``texts`` (batch, pos, norm, n: a text of n rows, each text
    of a batch once), written. ``vector`` has the ``size`` terms (numbers) that
    another text has too and their weights, packed, in the common order of
    ``prefix_terms``; its first ``n_index``, also in ``terms`` and ``ws``, are the
    row's index, by the L2 bound. All are empty if the row is near none. Rows without a term are left out. ``signed`` adds ``keys``,
    the entries of ``hyperplane_index``, from all terms of the row.

    Texts lie in groups of about ``group_chars`` characters. A group asks once
    for each of its distinct terms, by hash; what comes back are the df of the
    terms that several texts have. No (row, term) is exchanged."""
    groups = max(1, -(-chars // group_chars))
    bands = BANDS if signed else 0
    terms = (texts.filter("norm <> '' AND batch IS NOT NULL")
             .withColumn("grp", F.pmod(F.xxhash64("batch", "pos"), F.lit(groups)).cast("int"))
             .repartition(groups, "grp")
             .select("grp", "batch", "pos", "n", T.tokens(F.col("norm")).alias("toks"))
             .select("grp", "batch", "pos", "n", F.concat(T.ngram_terms(F.col("toks")), F.array(F.lit(""))).alias("terms")))
    hashed = terms.select("grp", "batch", "pos", "n", F.transform("terms", lambda t: F.xxhash64(F.col("batch"), t)).alias("a"),
                          F.transform("terms", lambda t: F.shiftright(F.hash(t, F.col("batch")), 16).cast("short")).alias("b"),
                          *([F.transform("terms", lambda t: F.xxhash64(t)).alias("s")] if signed else []))
    asked = hashed.select("grp", "pos", "n", "a", "b").groupBy("grp").applyInArrow(
        _ask(groups), "grp int, part int, start int, a binary, b binary, df binary, texts binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "grp int, part int, at binary, number binary, df binary")
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = f"batch {kinds['batch']}, pos {kinds['pos']}, terms array<long>, ws array<double>, n_index int, rest double, size int, vector binary"
    return stored(hashed.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
        _weigh(threshold, bands, BAND_BITS, seed), schema + (", keys array<long>" if signed else "")))


#: Pairs that are verified together.
PAIRS_PER_GROUP = 20_000
#: Rows up to which the table of rows that pairs use is broadcast.
USES_BROADCAST = 500_000


def _verified_rows(cand: DataFrame, rows: DataFrame, threshold: float, pairs_per_group: int = PAIRS_PER_GROUP) -> DataFrame:
    """``verified`` with ``shared_rows``. Pairs whose later row has the same
    first candidate (mostly one cluster of near copies) are taken together, so
    a row's arrays are sent once for them all and not once a pair; many pairs
    of one such cluster are cut into squares by the hashes of i and j."""
    first = F.min("i").over(Window.partitionBy("batch", "j"))
    labelled = cut_lineage(cand.select("batch", "i", "j", first.alias("lab")))
    sides = labelled.groupBy("batch", "lab").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / F.lit(pairs_per_group))).alias("cuts"))
    side = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.col("cuts"))
    pairs = labelled.join(sides, ["batch", "lab"]).select("batch", "i", "j", F.xxhash64("batch", "lab", side("i", 1), side("j", 2)).alias("at"))
    uses = pairs.select("at", "batch", F.col("i").alias("pos")).unionByName(pairs.select("at", "batch", F.col("j").alias("pos"))).distinct()
    uses = cut_lineage(uses)
    if uses.limit(USES_BROADCAST + 1).count() <= USES_BROADCAST:  # narrow: the arrays of other rows stay where they are
        uses = F.broadcast(uses)
    sent = uses.join(rows.select("batch", "pos", "size", "vector"), ["batch", "pos"]).select(
        F.col("at").alias("use"), F.col("batch").alias("of"), F.col("pos"), "size", "vector")
    kinds = {f.name: f.dataType.simpleString() for f in cand.schema.fields}

    def dots(pairs: pa.Table, sent: pa.Table) -> pa.Table:
        vectors = {}
        for b, p, size, vector in zip(*(sent.column(c).to_pylist() for c in ("of", "pos", "size", "vector")), strict=True):
            terms, ws = _unpacked(vector, size)
            order = np.argsort(terms)
            vectors[b, p] = terms[order], ws[order]
        sims = []
        for b, i, j in zip(*(pairs.column(c).to_pylist() for c in ("batch", "i", "j")), strict=True):
            (ti, wi), (tj, wj) = vectors[b, i], vectors[b, j]
            at = np.minimum(np.searchsorted(ti, tj), len(ti) - 1)
            sims.append(float(np.dot(wi[at] * (ti[at] == tj), wj)))
        near = pa.array(np.array(sims, dtype=np.float64) >= threshold)
        return pairs.select(["batch", "i", "j"]).append_column("sim", pa.array(sims, pa.float64())).filter(near)

    return pairs.groupBy("at").cogroup(sent.groupBy("use")).applyInArrow(
        dots, f"batch {kinds['batch']}, i {kinds['i']}, j {kinds['j']}, sim double")


def shared_index(rows: DataFrame) -> DataFrame:
    """The index of ``shared_rows``, as ``prefix_terms`` and ``hyperplane_index`` give it."""
    if "keys" in rows.columns:
        return rows.select("batch", "pos", F.explode("keys").alias("term"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("rest"))
    x = F.arrays_zip(F.slice("terms", F.lit(1), F.col("n_index")).alias("term"), F.slice("ws", F.lit(1), F.col("n_index")).alias("w"))
    return (rows.select("batch", "pos", "rest", F.explode(x).alias("x"))
            .select("batch", "pos", F.col("x.term").alias("term"), F.col("x.w").alias("weight"), "rest"))


def similar_pairs_signed(rows: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """``similar_pairs_lsh`` of signed ``shared_rows``: a row whose shared terms
    have a norm below the threshold is near none, and makes no candidates."""
    idx = shared_index(rows).select("batch", "pos", "term")
    a, b = idx.withColumnRenamed("pos", "i"), idx.withColumnRenamed("pos", "j")
    cand = a.join(b, ["batch", "term"]).filter(F.col("i") < F.col("j")).select("batch", "i", "j").distinct()
    return verified(cut_lineage(cand), rows, threshold)
