"""Row numbers and running sums within a key, without putting a key in one task.

``row_number() over (partition by k order by o)`` sends every row of a key to
one task; a key holding a third of the data would then sit on one executor.
Here the rows are range-partitioned on ``(k, o)`` (a hot key is split over
many partitions), each partition numbers its own runs in one Arrow pass, and
the few keys that continue from an earlier partition get an offset from a
per-partition count table (at most one such key per partition, so that table
is bounded by the partition count and safe to broadcast). This is the
``zipWithIndex`` shape, keyed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.session import cut_lineage


#: Rows that one task sorts; more are dealt to as many tasks as that takes.
ROWS_PER_TASK = 1_000_000


def keyed_ordinal(df: DataFrame, keys: list[str], order: list, out: str = "rn",
                  measure: str | None = None, cum_out: str | None = None,
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row within its ``keys`` group
    in ``order`` (ties broken by the order columns only, so give a unique
    order). With ``measure``, also add ``cum_out`` = sum of ``measure`` over
    the earlier rows of the group (exclusive running sum)."""
    sort_cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    if num_partitions is None:
        df = cut_lineage(df)  # read for its size, for the bounds of the ranges and for the rows
        rows = df.count()
        if rows > ROWS_PER_TASK:
            num_partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
    # Without an explicit count, AQE may merge neighbouring range partitions
    # (they stay contiguous ranges, so per-task numbering stays correct).
    ranged = (df.repartitionByRange(num_partitions, *sort_cols) if num_partitions
              else df.repartitionByRange(*sort_cols)).sortWithinPartitions(*sort_cols)

    out_schema = T.StructType(list(ranged.schema.fields) + [
        T.StructField("_pid", T.IntegerType(), False),
        T.StructField("_lrn", T.LongType(), False),
        T.StructField("_lcum", T.DoubleType(), False),
    ])
    key_names = list(keys)
    measure_name = measure

    def number_runs(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_key = None
        run_len = 0
        run_sum = 0.0
        for rb in batches:
            rows = rb.num_rows
            if rows == 0:
                continue
            change = np.zeros(rows, dtype=bool)
            if key_names:
                # consecutive rows differ when any key's factor code differs
                codes = np.stack([pd.factorize(rb.column(k).to_pandas(), use_na_sentinel=True)[0]
                                  for k in key_names], axis=1)
                change[1:] = (codes[1:] != codes[:-1]).any(axis=1)
                first = tuple(rb.column(k)[0].as_py() for k in key_names)
                last = tuple(rb.column(k)[rows - 1].as_py() for k in key_names)
            else:
                first = last = ()
            change[0] = first != last_key
            idx = np.arange(rows, dtype=np.int64)
            start = np.maximum.accumulate(np.where(change, idx, 0))
            # rows before the first change continue the previous batch's run
            cont = ~np.maximum.accumulate(change)
            lrn = idx - start + 1 + np.where(cont, run_len, 0)
            if measure_name is not None:
                m = np.nan_to_num(np.asarray(
                    rb.column(measure_name).to_numpy(zero_copy_only=False), dtype=np.float64))
                excl = np.cumsum(m) - m
                lcum = excl - excl[start] + np.where(cont, run_sum, 0.0)
            else:
                m = np.zeros(rows)
                lcum = np.zeros(rows)
            last_key = last
            run_len = int(lrn[-1])
            run_sum = float(lcum[-1] + m[-1])
            yield pa.RecordBatch.from_arrays(
                list(rb.columns) + [pa.array(np.full(rows, pid, dtype=np.int32)),
                                    pa.array(lrn.astype(np.int64)),
                                    pa.array(lcum.astype(np.float64))],
                schema=pa.schema(list(rb.schema) + [
                    pa.field("_pid", pa.int32(), False),
                    pa.field("_lrn", pa.int64(), False),
                    pa.field("_lcum", pa.float64(), False)]))

    local = cut_lineage(ranged.mapInArrow(number_runs, out_schema))

    # Rows and measure per (partition, key); then the offset each key carries
    # into a partition from the partitions before it.
    agg = [F.max("_lrn").alias("_cnt")]
    if measure:
        agg.append(F.sum(F.coalesce(F.col(measure).cast("double"), F.lit(0.0))).alias("_msum"))
    stats = local.groupBy("_pid", *keys).agg(*agg)
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.select("_pid", *keys,
                        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                        (F.coalesce(F.sum("_msum").over(w), F.lit(0.0)) if measure
                         else F.lit(0.0)).alias("_moff"))
    # Only the first key of a partition can continue from earlier partitions,
    # so this table has at most one row per partition: a proven bound.
    offs = cut_lineage(offs.filter((F.col("_off") > 0) | (F.col("_moff") != 0)))
    res = local.join(F.broadcast(offs), on=["_pid", *keys], how="left")
    res = res.withColumn(out, F.col("_lrn") + F.coalesce(F.col("_off"), F.lit(0)))
    if measure:
        res = res.withColumn(cum_out or f"{measure}_before",
                             F.col("_lcum") + F.coalesce(F.col("_moff"), F.lit(0.0)))
    return res.drop("_pid", "_lrn", "_lcum", "_off", "_moff")
