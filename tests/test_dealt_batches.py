"""Batches that lie whole in tasks: weighed and compared there, with little written."""
import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wirefold.operators import dedup as D
from wirefold.operators import similarity as S
from wirefold.plans import catalog
from wirefold.session import DROP_SHUFFLES, cut_lineage, ensure_checkpoint_dir, stored

WORDS = ["alpha", "beta", "gämma", "日本", "word", "x1", "x2", "foo", "bar", "b"]


def _odd_rows(spark):
    rnd, rows = random.Random(3), []
    for b in ("p", "q", "r", None):
        for i in range(25):
            rows.append((b, i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 6)))))
            if rnd.random() < 0.3:
                rows.append(rows[-1])
            if rnd.random() < 0.3:
                rows.append((b, i, " ".join(rnd.choice(WORDS) for _ in range(4))))
        rows.append((b, None, "alpha beta"))
    return spark.createDataFrame(rows, "batch string, pos long, norm string")


def _long_texts(rows: int, seed: int = 5):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(4000)]
    return [" ".join(rnd.choice(words) for _ in range(900)) for _ in range(rows)]


def _written(spark, run) -> int:
    """Bytes that ``run`` leaves in the checkpoint folder while its result lives."""
    top = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    files = lambda: {p: p.stat().st_size for p in top.rglob("part-*")}
    before, result = files(), run()
    result.count()
    return sum(n for p, n in files().items() if p not in before)


def test_packed_batches_give_the_pairs_of_the_weights(spark, monkeypatch):
    docs = _odd_rows(spark)
    d = S.dealt(docs)
    reps = D.first_copies(docs).filter("pos = rep").select("batch", "pos")
    others = reps.unionByName(spark.createDataFrame([("no such batch", 1)], "batch string, pos long"))
    for cap, members in ((5000, None), (None, reps), (6, reps), (1, None)):
        weights = S.tfidf(docs, cap, names=False, d=d)
        want = {(r["batch"], r["i"], r["j"]): round(r["sim"], 9) for r in S.similar_pairs(weights, 0.5, members, d).collect()}
        got = S.similar_pairs(S.tfidf(docs, cap, d=d, packed=True, members=members and others), 0.5).collect()
        assert {(r["batch"], r["i"], r["j"]): round(r["sim"], 9) for r in got} == want and len(got) == len(want) > 10
        packed = S.tfidf(docs, cap, d=d, packed=True).select("batch", F.explode("pos").alias("pos"))
        assert set(packed.filter("pos IS NOT NULL").collect()) == set(weights.filter("pos IS NOT NULL").select("batch", "pos").distinct().collect())


def test_dots_are_the_same_in_blocks(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(2)
    dense = rng.random((30, 40)) * (rng.random((30, 40)) < 0.3)
    row, term = np.nonzero(dense)
    want = {(i, j): dense[i] @ dense[j] for i in range(30) for j in range(i + 1, 30) if dense[i] @ dense[j] >= 0.8}
    for block, product in ((10 ** 6, 10 ** 6), (160, 50), (40, 1)):
        monkeypatch.setattr(S, "BLOCK_CELLS", block)
        monkeypatch.setattr(S, "PRODUCT_CELLS", product)
        got = [(int(i), int(j), s) for x in S._dots(row, term, dense[row, term], 0.8) for i, j, s in zip(*x, strict=True)]
        assert {(i, j) for i, j, _ in got} == set(want) and len(got) == len(want) > 20
        assert all(abs(s - want[i, j]) < 1e-12 for i, j, s in got)


def test_dedup_of_batches_writes_less_than_their_text(spark):
    texts = _long_texts(200)
    docs = spark.createDataFrame([(f"b{i // 50}", i, t) for i, t in enumerate(texts)], "batch string, pos long, norm string")
    assert _written(spark, lambda: D.dedup_flags(docs)) < 0.8 * sum(map(len, texts))


def test_report_is_the_same_in_both_forms_and_its_shuffle_files_go(spark, monkeypatch):
    docs = _odd_rows(spark)
    both = lambda: [sorted(map(repr, x.select(*[F.round(c, 9).alias(c) if c == "sim" else c for c in x.columns]).collect()))
                    for x in D.dedup_flags(docs, 0.5, with_report=True)]
    flags, report = both()
    monkeypatch.setattr(D, "BLOCK_ROWS", 0)  # rows of terms
    assert both() == [flags, report] and len(report) > 10
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before = files()
    stored(spark.range(5000).repartition(40, "id"))
    assert files() <= before


def test_similar_pairs_query_writes_less_than_its_text(spark, tmp_path):
    texts = _long_texts(200)
    pq.write_table(pa.table({"doc_id": pa.array(range(200), pa.int64()), "source": ["s0", "s1"] * 100, "text": texts, "lang": ["en"] * 200}),
                   tmp_path / "documents.parquet")
    written = _written(spark, lambda: catalog.QUERIES["similar_pairs"](spark, str(tmp_path)))
    assert written < 0.8 * sum(map(len, texts))


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before = files()
    cut = cut_lineage(spark.range(5000).repartition(40, "id").groupBy("id").count())
    assert files() <= before and cut.count() == 5000
    assert spark.conf.get(DROP_SHUFFLES, "false") == "false"


def test_texts_found_by_their_copies_are_the_distinct_ones(spark, monkeypatch):
    docs = _odd_rows(spark).dropDuplicates(["batch", "pos"])
    rows = lambda x: sorted(map(repr, x.filter("batch IS NOT NULL").select("batch", "pos", "norm", "n").collect()))
    want = rows(D.distinct_texts(docs))
    for most in (S.USES_BROADCAST, 0):
        monkeypatch.setattr(S, "USES_BROADCAST", most)
        assert rows(D.distinct_texts(docs, cut_lineage(D.first_copies(docs)))) == want and len(want) > 30


def test_packed_vectors_come_back_and_are_small():
    import numpy as np
    rng = np.random.default_rng(4)
    for n in (0, 1, 700):
        terms = np.sort(rng.integers(0, 1 << 36, n))
        ws = np.repeat(rng.random(1 + n // 50), 50)[:n] if n > 1 else rng.random(n)
        back = S._unpacked(packed := S._packed(terms, ws), n)
        assert all((x == y).all() for x, y in zip(back, (terms, ws), strict=True))
    assert len(packed) < 8 * n  # 16 bytes an entry before
