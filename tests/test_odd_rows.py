"""Registered queries on tables of a few odd rows."""
from wirefold.plans.catalog import QUERIES


def _query(spark, tmp_path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return QUERIES[name](spark, str(tmp_path)).collect()


def test_first_n_before_counts_blocks_and_their_links(spark, tmp_path):
    rows = [(3, t, "system" if t % 4 == 0 else "user", f"text {t}") for t in range(25)]
    got = _query(spark, tmp_path, "first_n_before", conversations=(rows, "conv_id long, turn int, role string, text string"))
    assert {(r["source_id"], r["n_considered"], r["n_with_link"]) for r in got} == {(2_003_000_000, 10, 7), (2_003_000_001, 5, 3)}


def test_ngrams_of_texts_without_terms(spark, tmp_path):
    got = _query(spark, tmp_path, "ngrams", documents=([(1, "a b ."), (2, ""), (3, None), (4, "one two one two")], "doc_id long, text string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {1: (0, 0, None), 2: (0, 0, None), 3: (0, 0, None), 4: (7, 4, "one two")}
