import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def step(spark, docs, stage, path):
    dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "decontaminate", "packing"]


def test_decisions_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*DOCS)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    good = step(spark, docs, "quality", f"{tmp_path}/1")
    once = step(spark, good, "exact_dedup", f"{tmp_path}/2")
    left = {r["doc_id"] for r in good.collect()}
    best = {}
    for i in left:
        best[norm(texts[i])] = max(i, best.get(norm(texts[i]), i))
    assert good.columns == DOCS and once.columns == DOCS
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(best.values())
    from test_simhash import brute_groups
    far = step(spark, once, "simhash", f"{tmp_path}/3")
    want = {c for _, _, c in brute_groups([(i, texts[i], None) for i in best.values()])}
    assert {r["doc_id"] for r in far.collect()} == want and far.count() == len(want)
    from test_decontaminate import brute
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = step(spark, far, "decontaminate", f"{tmp_path}/4")
    got = {r["doc_id"] for r in clean.collect()}
    # brute force over the documents that share a word run with an item, and some others
    words = lambda t: t.lower().split()
    runs = {tuple(words(t)[k:k + 5]) for _, t in items for k in range(len(words(t)) - 4)}
    near = {i for i in want if any(tuple(words(texts[i])[k:k + 5]) in runs for k in range(len(words(texts[i])) - 4))}
    short = sorted(i for i in want - near if len(texts[i]) < 400)[:5]
    bad = {d for d, _ in brute([(i, texts[i]) for i in near | set(short) if len(texts[i]) < 3000], items)}
    judged = {i for i in near | set(short) if len(texts[i]) < 3000}
    assert bad and judged - got == bad and got <= want
    packed = step(spark, clean, "packing", f"{tmp_path}/5")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sums = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sums == {i: len(t.encode(texts[i], add_special_tokens=False).ids) + 1 for i in got}


def test_edge_rows_pass_through_every_stage(spark, docs_frame, edge_rows, tmp_path):
    docs = docs_frame(edge_rows)
    for k, (name, _) in enumerate(corpus_pipeline.STAGES):
        empty = step(spark, docs.limit(0), name, f"{tmp_path}/e{k}")
        assert empty.count() == 0
        out = step(spark, docs, name, f"{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == docs.columns
            docs = out if out.count() else docs
