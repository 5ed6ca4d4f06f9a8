import hashlib

from pyspark.sql import functions as F

from wirefold.llm.exact_dedup import dedup_stage, exact_dedup

COLS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    def norm(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    out, seen = [], set()
    for i, t, _ in rows:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        first = i == keep and (norm(t), i) not in seen
        seen.add((norm(t), i))
        out.append((i, keep, len(ids), first, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


def test_edge_rows(docs_frame, edge_rows):
    assert got(exact_dedup(docs_frame(edge_rows))) == brute(edge_rows)


def test_collisions_are_split_by_full_text(docs_frame, edge_rows):
    weak = lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 1))  # noqa: E731  16 digests
    assert got(exact_dedup(docs_frame(edge_rows), digest=weak)) == brute(edge_rows)


def test_small_batches_and_no_broadcast(docs_frame, edge_rows):
    df = docs_frame(edge_rows).repartition(5)
    assert got(exact_dedup(df, files_per_batch=1, broadcast_rows=0)) == brute(edge_rows)


def test_empty_table(docs_frame):
    assert exact_dedup(docs_frame([])).count() == 0


def test_stage_keeps_columns_and_one_row_per_text(spark, docs_frame, edge_rows):
    df = docs_frame(edge_rows)
    out = dedup_stage(spark, df, "")
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(kept, key=repr) == sorted([r[0] for r in brute(edge_rows) if r[3]], key=repr)


def test_native_plan(docs_frame, edge_rows, capsys):
    exact_dedup(docs_frame(edge_rows)).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow"))
