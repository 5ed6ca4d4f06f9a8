"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Spark's setting that removes the shuffle files of a query when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes of a batch that a Python worker is sent.
SENT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows up to which a narrow side (a few dozen bytes a row) is broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, sent_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut
    and the rows survive the loss of any executor. The shuffle files of the
    write are removed at its end; if ``sent_bytes`` is given, Python workers
    are sent batches of about so many bytes, whatever the number of rows (both
    by settings of Spark, put back afterwards)."""
    spark = df.sparkSession
    path = scratch(spark, label)
    settings = {DROP_SHUFFLES: "true"} | ({SENT_BYTES: str(sent_bytes)} if sent_bytes else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``limit`` rows;
    otherwise as it is, for a shuffled join. Give it stored, narrow frames."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null counts as empty.
    Texts of one byte a character take the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, LOWER)))


def pick_rows(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose key values are in ``kept``, one for each
    distinct key, with the columns of ``docs``.

    ``keys`` maps the column names of ``kept`` to expressions over ``docs``;
    ``kept`` is unique by them and has ``times``, the number of rows of
    ``docs`` with that key. Null key values match null key values. Repeated
    rows of one key are one document: any one of them stays. Only those are
    shuffled to find it; other texts stay where they are if ``kept`` is small.
    """
    cols = docs.columns
    names = {k: f"__key_{i}" for i, k in enumerate(keys)}
    wanted = stored(kept.select(*[F.col(k).alias(f"{n}_k") for k, n in names.items()], F.col("times").alias("__times")),
                    "picked")
    keyed = docs.withColumns({n: keys[k] for k, n in names.items()})
    on = None
    for n in names.values():
        one = F.col(n).eqNullSafe(F.col(f"{n}_k"))
        on = one if on is None else on & one
    joined = keyed.join(broadcast_if_small(wanted), on, "inner")
    if wanted.filter("__times > 1").isEmpty():
        return joined.select(*cols)
    once = joined.filter("__times = 1").select(*cols)
    return once.unionAll(joined.filter("__times > 1").dropDuplicates(list(names.values())).select(*cols))
