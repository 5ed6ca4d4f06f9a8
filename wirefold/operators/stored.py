"""Stored state: changes written so that a repeated write changes nothing.

Append-only tables (``append_batch``) keep each batch in a folder of its own,
``batch_id=N``; writing it again replaces it. A keyed table (``KeyedTable``)
lies in ``bucket=B`` folders, the bucket a hash of the columns that changes
come by. A change reads and rewrites only the buckets that its keys fall into
(dynamic partition overwrite), so its cost follows the changes; the other
buckets keep their files. What a change writes depends on the stored rows and
the change alone, and applying it again gives the same rows, so a job that was
lost half-way is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.operators import state as ST
from wirefold.session import cut_lineage

#: Batch of the rows that a table starts with.
FIRST = -1


def append_batch(rows: DataFrame, path: str, batch_id: int = FIRST) -> None:
    """Write one batch of an append-only table; a repeat replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows of an append-only table, of batches earlier than ``before``."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(full).parquet(path)
    return (rows if before is None else rows.filter(F.col("batch_id") < before)).drop("batch_id")


class KeyedTable:
    """A table in buckets of the columns ``by``. ``buckets`` belongs to the
    table's layout: choose it so that a bucket is some hundred megabytes at the
    size expected, and ``copy_to`` a table of more buckets when it outgrows
    them. A bucket without rows keeps one dead row, as an overwrite of nothing
    would leave the old rows in place."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.by, self.buckets = spark, path, schema, by, buckets
        self._stored = T.StructType([*schema.fields, T.StructField("_live", T.BooleanType()),
                                     T.StructField("bucket", T.IntegerType())])

    def _bucket(self, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> KeyedTable:
        """Write the first rows, in place of all there are."""
        every = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))
        self._write(rows.select(*self.schema.names), every, "static")
        return self

    def read(self) -> DataFrame:
        return self._rows().select(*self.schema.names)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(self.path).filter("_live")

    def _write(self, rows: DataFrame, buckets: DataFrame, mode: str = "dynamic") -> None:
        live = rows.withColumn("_live", F.lit(True)).withColumn("bucket", self._bucket(*self.by))
        dead = buckets.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields],
                              F.lit(False).alias("_live"), "bucket")
        (cut_lineage(live.unionByName(dead)).repartition("bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(self.path))

    def change(self, changes: DataFrame, by: list[str], new_state: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Rewrite the buckets of ``changes`` (whose columns ``by`` hold the
        bucket columns' values) as ``new_state(their rows, changes)``."""
        changes = cut_lineage(changes)
        touched = cut_lineage(changes.select(self._bucket(*by).alias("bucket")).distinct())
        numbers = [r["bucket"] for r in touched.collect()]  # at most ``buckets``
        if numbers:
            # by number, so that the other buckets' folders aren't read
            state = self._rows().filter(F.col("bucket").isin(numbers)).select(*self.schema.names)
            self._write(new_state(state, changes), touched)

    def insert_or_ignore(self, changes: DataFrame, keys: list[str], order: list[str],
                         defaults: dict[str, Column] | None = None) -> None:
        """Unique ``keys``: the stored row wins, then the first arrival. Rows
        with a NULL key always go in; a repeat would add them again, so keep
        them in an append-only table."""
        self.change(changes, self.by, lambda state, new: ST.apply_insert_or_ignore(state, new, keys, order, defaults))

    def upsert(self, changes: DataFrame, keys: list[str], set_cols: list[str], seq: list[str],
               defaults: dict[str, Column] | None = None) -> None:
        self.change(changes, self.by, lambda state, new: ST.upsert(state, new, keys, set_cols, seq, defaults))

    def update(self, changes: DataFrame, keys: list[str], set_cols: list[str]) -> None:
        self.change(changes, self.by, lambda state, new: ST.update_by_key(state, new, keys, set_cols, flag=None))

    def delete(self, doomed: DataFrame, column: str, returning: str | None = None) -> DataFrame | None:
        """Delete rows whose ``by`` column is among ``doomed[column]``; with
        ``returning``, the values of that column of the rows deleted."""
        assert len(self.by) == 1
        gone = cut_lineage(doomed.select(F.col(column).alias("_gone")).distinct())
        dead = None
        if returning:
            numbers = [r[0] for r in gone.select(self._bucket("_gone")).distinct().collect()]
            rows = self._rows().filter(F.col("bucket").isin(numbers))
            dead = cut_lineage(rows.join(gone, F.col(self.by[0]) == F.col("_gone"), "left_semi").select(returning))
        self.change(gone, ["_gone"], lambda state, new: state.join(new, F.col(self.by[0]) == F.col("_gone"), "left_anti"))
        return dead

    def copy_to(self, path: str, buckets: int) -> KeyedTable:
        """The same rows in another number of buckets."""
        return KeyedTable(self.spark, path, self.schema, self.by, buckets).create(self.read())


def delete_stored_cascade(tables: list[tuple[KeyedTable, str]], doomed: DataFrame, column: str) -> None:
    """Delete parents and, level by level, their children. ``tables`` holds
    (table in buckets of the column that points to the level above, or of its
    key at the top; its key), from the top down. Children go first, so a run
    that was lost half-way finds the parents again and finishes."""
    levels, gone, name = [], doomed, column
    for table, key in tables:
        levels.append((table, gone, name))
        numbers = [r[0] for r in gone.select(table._bucket(name)).distinct().collect()]
        rows = table._rows().filter(F.col("bucket").isin(numbers))
        gone = cut_lineage(rows.join(gone.select(F.col(name).alias("_gone")), F.col(table.by[0]) == F.col("_gone"), "left_semi").select(key))
        name = key
    for table, gone, name in reversed(levels):
        table.delete(gone, name)
