import hashlib
import math

import duckdb
import pytest

from wirefold.llm.clustering import OP13_SQL, cluster_vectors, op13_centroids

INF, NAN = float("inf"), float("nan")


def brute(rows, clusters, rounds, components, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=rank)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, members in groups.items():
            centroids[k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + d
    return sorted(((i, k, d, inertia[k], sum(inertia.values())) for i, k, d in found), key=repr), centroids


def rows_of(frame):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"]) for r in frame.collect()), key=repr)


EDGE = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (1, [0.4, 0.0]), (None, [0.1, 0.1]), (None, [0.1, 0.2]), (2, None), (3, []), (4, [1.0]),
        (5, [1.0, 2.0, 3.0]), (6, [None, 1.0]), (7, [NAN, 1.0]), (8, [INF, 1.0]), (9, [-INF, 1.0]), (10, [-0.0001, 0.0001]),
        (11, [1.0, 1.0]), (12, [-1.0, -1.0]), (13, [0.0, 0.0]), (14, [0.0, 0.0]), (15, [0.0, 0.0]), (16, [99999.5, -99999.5])]


@pytest.mark.parametrize("clusters", [1, 3, 8, 50])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_edges_equal_brute_force(spark, clusters, kind):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in EDGE], f"vec_id long, embedding array<{kind}>, cluster int, distance int").repartition(3)
    stored = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got, centroids = cluster_vectors(frame, clusters, 6, 2)
    want, finals = brute(stored, clusters, 6, 2)
    assert rows_of(got) == want and centroids == finals


def test_many_vectors_and_a_hot_one(spark):
    import random
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(i % 5, 0.3) for _ in range(4)]) for i in range(1500)] + [(5000 + i, [0.25, 0.5, 0.75, 1.0]) for i in range(800)]
    got, centroids = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), 8, 10, 4)
    want, finals = brute(rows, 8, 10, 4)
    assert rows_of(got) == want and centroids == finals


def test_empty_and_too_large(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    rows, centroids = cluster_vectors(none)
    assert rows.count() == 0 and centroids == []
    big = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(big, components=2)


def test_query_equals_its_sql(spark, sf_dir):
    got = op13_centroids(spark, sf_dir)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
        rel = c.sql(OP13_SQL)
        assert rel.columns == got.columns
        assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
