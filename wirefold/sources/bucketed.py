"""State that is not shuffled: tables bucketed and sorted by their key.

News by url (for insert-or-ignore) and news and sent log by news id (for the
pending rows) are saved with ``bucketBy``. A join on the key then reads the
state where it lies: only the changes are exchanged, to as many partitions as
the state has buckets. The files are in a folder that the caller names; the
table's entry is in the session's catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Save ``df`` as the table ``name`` under ``path``, in ``buckets`` buckets
    sorted by ``keys``, and return the table. Rows are dealt by key first, so
    each bucket is one file."""
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)
