import itertools
import math
import random
import re

import pytest

from wirefold.llm.decontaminate import MASKS, RATIO, WINDOW, decontaminate_stage, find_leaks, needed, run_length


def brute(docs, items):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in docs:
        a = words(t)
        for i, s in items:
            b = words(s)
            n = min(len(b), WINDOW)
            if n == 0:
                continue
            need = math.ceil(RATIO * n - 1e-9)
            for start in range(len(b) - n + 1):
                for at in range(-n + 1, len(a)):
                    if sum(0 <= at + j < len(a) and a[at + j] == b[start + j] for j in range(n)) >= need:
                        out.add((d, i))
    return out


def test_masks_find_any_two_substitutions():
    allowed = WINDOW - needed(WINDOW)
    assert allowed == 2
    for lost in itertools.combinations(range(WINDOW), allowed):
        assert any(all(s + o not in lost for o in m) for m in MASKS for s in range(WINDOW - m[-1]))


def test_runs_of_short_items_survive():
    for n in range(1, WINDOW):
        q = run_length(n)
        for lost in itertools.combinations(range(n), n - needed(n)):
            assert any(all(s + o not in lost for o in range(q)) for s in range(n - q + 1))


def substituted(rnd, words, n):
    words = list(words)
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"zz{rnd.randrange(99)}"
    return words


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 13, 12, 25, 7, 3, 1, 9, 30, 5])]
    items += [(50, None), (51, ""), (52, "?!"), (None, " ".join(word() for _ in range(20))), (8, items[8][1])]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rnd.randrange(0, 80))]
        part = (rnd.choice(items)[1] or "").split()
        if part and d % 3:
            lost = rnd.randrange(0, max(1, len(part) // 4))
            part = substituted(rnd, part, lost)[rnd.randrange(0, 3):]
            at = rnd.randrange(0, len(text) + 1)
            text[at:at] = part
        docs.append((d, ", ".join(text).upper() if d % 2 else " ".join(text)))
    docs += [(None, items[0][1]), (100, None), (101, ""), (102, "w1 " * 4000), (103, items[0][1]), (103, items[0][1])]
    return docs, items


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_leaks_equal_brute_force(spark, case, block_words):
    docs, items = case
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = find_leaks(d, b, block_words=block_words).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute(docs, items)
    assert len({(r["doc_id"], r["item_id"]) for r in rows}) == len(rows)


def test_empty_tables(spark, docs_frame):
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words of a benchmark")], "item_id long, text string")
    assert find_leaks(docs_frame([]), one).count() == 0
    assert find_leaks(docs_frame([(1, "some words of a benchmark", "en")]), b).count() == 0


def test_stage_and_native_plan(spark, capsys):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = decontaminate_stage(spark, docs, d)
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns
    for r in docs.collect():
        low = " ".join(r["text"].lower().split())
        if any(" ".join(i) in low for i in items):
            assert r["doc_id"] not in clean
    out.explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow"))
