import math
import random
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wirefold.llm import ngrams
from wirefold.llm.quality import cross_scores, discounts


def brute_model(texts):
    """Interpolated modified Kneser-Ney of order ngrams.ORDER by dictionaries."""
    order = ngrams.ORDER
    counts = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        line = [""] * (order - 1) + list(t)
        for i in range(order - 1, len(line)):
            counts[order][tuple(line[i - order + 1:i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    cuts, total, held = {}, defaultdict(float), defaultdict(float)
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        cuts[k] = [min(max(j - (j + 1) * y * b / a if a else 0.5 * j, 0.05), j - 0.05) for j, a, b in
                   ((1, n[1], n[2]), (2, n[2], n[3]), (3, n[3], n[4]))]
        for g, m in c.items():
            total[k, g[:-1]] += m
            held[k, g[:-1]] += cuts[k][min(m, 3) - 1]

    def p(gram):
        k = len(gram)
        low = p(gram[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        h = (k, gram[:-1])
        if h not in total:
            return low
        n = counts[k][gram]
        return (n - cuts[k][min(n, 3) - 1] if n else 0) / total[h] + held[h] / total[h] * low

    return lambda t: sum(math.log(p(tuple(([""] * (order - 1) + list(t))[i:i + order]))) for i in range(len(t)))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "__t_id long, text string")


def test_joined_scores_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcde éжщ中文😀") for _ in range(rnd.randrange(0, 60))) for _ in range(40)]
    model, symbols = ngrams.train(frame(spark, texts), discounts)
    lp = brute_model(texts)
    asked = texts + ["zzz", "abz é", "доброе утро", "x" * 100, None, ""]
    got = {r["__t_id"]: r["lp"] for r in ngrams.score(frame(spark, asked), model, symbols).collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        assert got[i] is None if not t else abs(got[i] - lp(t)) <= 1e-4 * abs(lp(t)), t


def test_texts_with_more_symbols_than_a_packed_key_holds(spark):
    texts = ["".join(map(chr, range(0x4E00, 0x4E00 + 5000))) + "abcabc", "abcabd"]
    model, symbols = ngrams.train(frame(spark, texts), discounts)
    lp = brute_model(texts)
    for r in ngrams.score(frame(spark, texts), model, symbols).collect():
        assert abs(r["lp"] - lp(texts[r["__t_id"]])) <= 1e-4 * abs(r["lp"])


def test_letters_of_any_script_are_told_apart(spark):
    greek, thai = ("".join(chr(a + i % 20) for i in range(400)) for a in (0x3B1, 0xE01))
    latin = "".join(chr(33 + i % 90) for i in range(4000))
    model, symbols = ngrams.train(frame(spark, [latin, latin, greek]), discounts)
    lp = {r["__t_id"]: r["lp"] for r in ngrams.score(frame(spark, [greek, thai]), model, symbols).collect()}
    assert lp[0] > lp[1] / 4


def test_the_model_grows_with_the_text(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(2000)]
    rows = [ngrams.train(frame(spark, [" ".join(words[:n])]), discounts)[0].count() for n in (100, 2000)]
    assert rows[1] > 10 * rows[0]
    assert ngrams.train(frame(spark, []).filter(F.lit(False)), discounts)[0].count() == 0


def test_no_document_is_judged_by_a_model_that_has_read_it(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abcde ") for _ in range(50)) for _ in range(20)]
    rows = frame(spark, texts)
    side = {r["__t_id"]: r["s"] for r in rows.select("__t_id", F.pmod(F.xxhash64("__t_id"), F.lit(2)).alias("s")).collect()}
    lp = {s: brute_model([t for i, t in enumerate(texts) if side[i] != s]) for s in (0, 1)}
    got = cross_scores(rows, rows.select("__t_id")).collect()
    assert len(got) == len(texts) and {*side.values()} == {0, 1}
    for r in got:
        want = lp[side[r["__t_id"]]](texts[r["__t_id"]])
        assert abs(r["lp"] - want) <= 1e-4 * abs(want)


def test_counting_passes_on_what_it_holds_and_keeps_few_copies(monkeypatch):
    rnd = random.Random(5)
    monkeypatch.setattr(ngrams, "BATCH_SYMBOLS", 10_000)
    texts = ["".join(rnd.choice("abcdefghij klmnop") for _ in range(4_000)) for _ in range(20)]
    whole, parts, rows = Counter(), Counter(), []
    for hi, lo, n in ngrams._counted(iter(texts)):
        whole.update(dict(zip(zip(hi.tolist(), lo.tolist(), strict=True), n.tolist(), strict=True)))
    for hi, lo, n in ngrams._counted(iter(texts), 15_000):
        rows.append(len(hi))
        for key, times in zip(zip(hi.tolist(), lo.tolist(), strict=True), n.tolist(), strict=True):
            parts[key] += times
    assert parts == whole and sum(whole.values()) == 80_000 and len(rows) > 1 and max(rows) < 40_000
    parts = [tuple(np.arange(500_000) for _ in range(3)) for _ in range(2)]
    tracemalloc.start()
    ngrams._summed(parts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not parts and most < 2.2 * 24_000_000, most


def test_a_stored_table_leaves_no_shuffle_files(spark):
    from wirefold.llm.common import DROP_SHUFFLES, stored

    before = spark.conf.get(DROP_SHUFFLES)
    seen = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: seen.getAllFiles().size()
    had = count()
    out = stored(spark.range(100_000).repartition(7, "id"), "test-shuffles")
    for _ in range(50):
        if count() <= had:
            break
        time.sleep(0.1)
    assert count() <= had and spark.conf.get(DROP_SHUFFLES) == before
    assert out.count() == 100_000


def test_groups_scored_in_parts_give_every_row_once(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcde ") for _ in range(30)) for _ in range(40)] + [None, ""]
    model, symbols = ngrams.train(frame(spark, texts), discounts)
    one = {r["__t_id"]: r["lp"] for r in ngrams.score(frame(spark, texts), model, symbols).collect()}
    many = ngrams.score(frame(spark, texts), model, symbols, group_chars=200).collect()
    assert len(many) == len(one) == len(texts)
    for r in many:
        assert (r["lp"] is None) == (one[r["__t_id"]] is None) and (r["lp"] is None or abs(r["lp"] - one[r["__t_id"]]) < 1e-9)


def test_counting_holds_few_bytes_for_each_ngram(monkeypatch):
    rnd = random.Random(7)
    monkeypatch.setattr(ngrams, "BATCH_SYMBOLS", 50_000)
    texts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJ", k=50_000)) for _ in range(20)]
    tracemalloc.start()
    found = next(ngrams._counted(iter(texts)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) > 990_000 and most < 50 * len(found[0]), most / len(found[0])


def test_counting_gives_each_ngram_once_however_many_symbols_there_are(monkeypatch):
    rnd = random.Random(9)
    monkeypatch.setattr(ngrams, "BATCH_SYMBOLS", 1_000)
    latin = lambda: "".join(rnd.choice("abcd ") for _ in range(1_500))
    han = lambda: "".join(chr(rnd.randrange(0x4E00, 0x4E00 + 1_500)) for _ in range(700))
    texts = [latin(), han(), latin(), han() + latin(), "", "é", latin() + "😀", han()]
    want = Counter()
    for t in texts:
        line = [ngrams.START] * (ngrams.ORDER - 1) + [ord(c) + 2 for c in t]
        for i in range(ngrams.ORDER - 1, len(line)):
            a, b, c, d, e, f = line[i - ngrams.ORDER + 1:i + 1]
            want[a << 42 | b << 21 | c, d << 42 | e << 21 | f] += 1
    for held in (None, 300):
        got, rows = Counter(), []
        for hi, lo, n in ngrams._counted(iter(texts), held):
            keys = list(zip(hi.tolist(), lo.tolist(), strict=True))
            assert len(set(keys)) == len(keys)
            rows.append(len(keys))
            for key, times in zip(keys, n.tolist(), strict=True):
                got[key] += times
        assert got == want and (len(rows) > 1) == (held is not None)


def test_workers_are_sent_batches_of_bounded_bytes(spark):
    from wirefold.llm.common import SENT_BYTES, stored

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    before = spark.conf.get(SENT_BYTES, None)
    texts = spark.range(2_000).select(F.repeat(F.col("id").cast("string"), 300).alias("text")).coalesce(1)
    found = [r["bytes"] for r in stored(texts.mapInArrow(sizes, "bytes long"), "test-sent", 100_000).collect()]
    assert len(found) > 10 and max(found) < 200_000 and spark.conf.get(SENT_BYTES, None) == before
