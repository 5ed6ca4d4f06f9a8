import random

import pytest
import xxhash
from pyspark.sql import functions as F

from wirefold.llm.simhash import components, fingerprint, rotation, simhash_groups, simhash_stage, trie_links


def brute_fp(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_groups(rows, k=4):
    fps = [brute_fp(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], signed(fps[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def near_rows(n=120, seed=3):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(3, 300))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 3)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(500)}"
        rows.append((i * 7 % 1000, " ".join(words), "en"))
    return rows


def test_fingerprint_matches_plain_count(edge_rows):
    for _, t, _ in edge_rows[:9] + near_rows(10):
        assert fingerprint(t or "") == brute_fp(t)


@pytest.mark.parametrize("leaf_size", [4096, 3])
def test_groups(docs_frame, edge_rows, leaf_size):
    rows = edge_rows + near_rows()
    got = simhash_groups(docs_frame(rows).drop("fp"), leaf_size=leaf_size).select("doc_id", "fp", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_groups(rows)


@pytest.mark.parametrize(("k", "leaf_size", "step"), [(4, 4096, 3), (4, 9, 8), (1, 9, 16)])
def test_links_equal_all_pairs(spark, k, leaf_size, step):
    rnd = random.Random(k)
    hot = rnd.getrandbits(64)
    values = {hot ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 6))) for _ in range(150)}
    values |= {rnd.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1, 1, 1 << 63}
    values = sorted(values)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= k}
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    assert {tuple(r) for r in trie_links(fps, k, leaf_size, step).collect()} == want


def test_budgets_rise_to_k():
    for k in (1, 3, 4, 8):
        for r in range(k + 1):
            shift, budget = rotation(k, r)
            assert len(budget) == 65 and budget[-1] == k and budget == sorted(budget) and 0 <= shift < 64


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    links = links.unionAll(spark.createDataFrame([(1000, 1001), (1001, 1002)], "u long, v long"))
    got = {r["v"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_empty_table_and_stage(spark, docs_frame, edge_rows):
    assert simhash_groups(docs_frame([]).drop("fp")).count() == 0
    df = docs_frame(edge_rows)
    out = simhash_stage(spark, df, "")
    want = {(i, c) for i, _, c in brute_groups(edge_rows)}
    kept = sorted((r["doc_id"] for r in out.collect()), key=repr)
    assert out.columns == df.columns
    assert kept == sorted({c for _, c in want}, key=repr)
