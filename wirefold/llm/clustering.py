"""Centroid clustering by scalar lookup tables.

Vectors become integer vectors. They are stored once in blocks (one Arrow
batch each); a block holds, for every dimension, the integer values that occur
in it and each vector's code among them. A round tabulates, for a dimension,
the squared difference between every occurring value and every centroid; the
distances of the block are gathers from those tables, summed over dimensions.
All arithmetic is on 64-bit integers, so results are exact.

A round is one narrow pass: each task returns, whatever its number of rows,
one row per cluster and dimension; their sums (clusters x dimensions numbers)
come to the driver, which takes the floored means. Tables never leave a task,
and their size is bounded by the block's. No row is shuffled at all, so a hot
vector is as cheap as any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm.common import stored, table

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Largest size of an integer component: 64 squared differences of such fit in a long.
LARGEST = 2 ** 27
#: Rows of a block at most; codes are 16 bits wide.
BLOCK_ROWS = 1 << 15

BLOCKS = "ids array<long>, counts binary, found binary, codes binary"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<int>): floor(scale * x) of the vectors with exactly
    ``components`` components, none null, NaN or infinite; others are left out.
    A finite component beyond ``LARGEST`` after scaling ends the job with an
    error, since its squared distances don't fit in a long."""
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = raw.filter(F.col("x").isNotNull() & (F.size("x") == components)).filter(fine)
    scaled = F.transform("x", lambda x: F.when(F.abs(x) * float(scale) < float(LARGEST),
                                               F.floor(x * float(scale)).cast("int"))
                         .otherwise(F.raise_error(F.lit("a vector component is too large for exact distances"))
                                    .cast("int")))
    return kept.select("vec_id", scaled.alias("v"))


def _encode(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("found", pa.binary()),
                        ("codes", pa.binary())])
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(at, BLOCK_ROWS)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
            counts, found, codes = [], [], []
            for column in flat.T:
                values, code = np.unique(column, return_inverse=True)
                counts.append(len(values))
                found.append(values.astype("<i4").tobytes())
                codes.append(code.astype("<u2").tobytes())
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([np.array(counts, "<i4").tobytes()]), pa.array([b"".join(found)], pa.binary()),
                 pa.array([b"".join(codes)], pa.binary())], schema=schema)


def encode_blocks(kept: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The integer vectors in blocks of occurring values and codes."""
    return kept.mapInArrow(lambda batches: _encode(batches, components), BLOCKS)


class Block:
    """One block of vectors: ids, and per dimension the occurring values and the codes."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.ids = batch.column(0)[row].values
        counts = np.frombuffer(batch.column(1)[row].as_py(), "<i4")
        found = np.frombuffer(batch.column(2)[row].as_py(), "<i4").astype(np.int64)
        self.values = np.split(found, np.cumsum(counts)[:-1])
        self.codes = np.frombuffer(batch.column(3)[row].as_py(), "<u2").reshape(len(counts), -1)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of every vector;
        of equally near ones the smallest number."""
        total = np.zeros((len(self.ids), len(centroids)), dtype=np.int64)
        for values, codes, wanted in zip(self.values, self.codes, centroids.T, strict=True):
            squares = (values[:, None] - wanted[None, :]) ** 2
            total += squares[codes]
        nearest = total.argmin(axis=1)
        return nearest, total[np.arange(len(nearest)), nearest]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row)


def totals(blocks: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """(cluster, dimension) -> sum of that component over the cluster's vectors;
    dimension -1 is their number, -2 the sum of their squared distances."""
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for block in _blocks(batches):
            nearest, distance = block.assign(centroids)
            size = np.bincount(nearest, minlength=k)
            for c in np.flatnonzero(size).tolist():
                sums[c, -1] = sums.get((c, -1), 0) + int(size[c])
                sums[c, -2] = sums.get((c, -2), 0) + sum(distance[nearest == c].tolist())
            for d, (values, codes) in enumerate(zip(block.values, block.codes, strict=True)):
                # whole numbers below 2^53 (at most 2^15 rows of 2^27): exact as doubles
                for c, s in enumerate(np.bincount(nearest, weights=values[codes], minlength=k).tolist()):
                    sums[c, d] = sums.get((c, d), 0) + int(s)
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array([c for c, _ in keys], pa.int32()), "dim": pa.array([d for _, d in keys], pa.int32()),
                "part": pa.array([str(sums[x]) for x in keys], pa.string())})

    parts = blocks.mapInArrow(add, "cluster int, dim int, part string")
    rows = parts.groupBy("cluster", "dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    return {(r["cluster"], r["dim"]): int(r["s"]) for r in rows}


def seeds(kept: DataFrame, clusters: int, prefix: str) -> np.ndarray:
    """The vectors of the smallest SHA-256 of ``prefix`` and vec_id, in that
    order; null ids come last, equal ids in the order of their components."""
    rank = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    rows = (kept.withColumn("rank", rank).orderBy(F.col("rank").asc_nulls_last(), "v").limit(clusters)
            .select("v").collect())
    return np.array([r["v"] for r in rows], dtype=np.int64)


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS,
                    components: int = COMPONENTS, scale: int = SCALE, seed_prefix: str = "3:",
                    id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(rows, final centroids). Rows: vec_id, cluster, distance, cluster_size,
    cluster_inertia, inertia, one for each kept vector.

    Vectors that are null, of another length, or hold a null, NaN or infinite
    component are left out. Repeated rows and repeated or null ids are vectors
    like any other. With fewer vectors than ``clusters`` each is a seed; an
    empty table gives no rows and no centroids. Further columns aren't read.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, id_col, vector_col, components, scale)
    centroids = seeds(kept, clusters, seed_prefix)
    out = ("vec_id long, cluster int, distance long, cluster_size long, cluster_inertia long, inertia long")
    if not len(centroids):
        return spark.createDataFrame([], out), []
    blocks = stored(encode_blocks(kept, components), "vector-blocks")
    for _ in range(rounds):
        sums = totals(blocks, centroids)
        moved = centroids.copy()
        for c in range(len(centroids)):
            if size := sums.get((c, -1), 0):
                moved[c] = [sums[c, d] // size for d in range(components)]
        if (moved == centroids).all():
            break  # every further round would give the same
        centroids = moved
    sums = totals(blocks, centroids)
    sizes = [sums.get((c, -1), 0) for c in range(len(centroids))]
    inertias = [sums.get((c, -2), 0) for c in range(len(centroids))]
    whole = sum(inertias)
    final = centroids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, inertia = np.array(sizes, np.int64), np.array(inertias, np.int64)
        for block in _blocks(batches):
            nearest, distance = block.assign(final)
            yield pa.RecordBatch.from_arrays(
                [block.ids, pa.array(nearest.astype(np.int32)), pa.array(distance), pa.array(size[nearest]),
                 pa.array(inertia[nearest]), pa.array(np.full(len(nearest), whole, np.int64))],
                names=["vec_id", "cluster", "distance", "cluster_size", "cluster_inertia", "inertia"])

    return blocks.mapInArrow(rows, out), centroids.tolist()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    digest = F.element_at(F.array(*map(F.lit, digests or [""])), F.col("cluster") + 1)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                       digest.alias("centroid_sha256"), "cluster_size")


def _sql() -> str:
    """The rounds written out one after another."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS a
  FROM embeddings WHERE len(embedding) = {COMPONENTS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, a) - 1 AS k, a
  FROM (SELECT sha256('3:' || vec_id) AS h, a FROM v ORDER BY h NULLS LAST, a LIMIT {CLUSTERS}))"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""d{n} AS MATERIALIZED (
  SELECT rid, k, dist FROM (
    SELECT v.rid, c.k, list_sum(list_transform(range(1, {COMPONENTS} + 1), lambda i: (v.a[i] - c.a[i]) * (v.a[i] - c.a[i])))::BIGINT AS dist
    FROM v, c{n} c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, k) = 1)""")
        if n < ROUNDS:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.a, c.a) AS a FROM c{n} c LEFT JOIN (
    SELECT k, list(x ORDER BY i) AS a FROM (
      SELECT k, i, floor(sum(a[i])::DOUBLE / count(*))::BIGINT AS x
      FROM d{n} JOIN v USING (rid), range(1, {COMPONENTS} + 1) t(i) GROUP BY k, i)
    GROUP BY k) m USING (k))""")
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, d.k::INTEGER AS cluster, d.dist AS distance,
  (sum(d.dist) OVER (PARTITION BY d.k))::BIGINT AS cluster_inertia, (sum(d.dist) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.a, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY d.k) AS cluster_size
FROM d{ROUNDS} d JOIN v USING (rid) JOIN c{ROUNDS} c ON c.k = d.k"""


OP13_SQL = _sql()
