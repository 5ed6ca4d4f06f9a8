"""Batch enrichment hook: rows without a summary go to a user function in
batches of ``size``; ids missing from its answer keep what they had.

The user function gets one pandas DataFrame per batch (at most ``size``
rows) and returns ``(id, summary)`` rows; Spark runs it with ``mapInPandas``
over partitions sorted by the batch key, each cut where the key changes, so
batches run in parallel and no batch grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.operators.ordinal import keyed_ordinal

BATCH_SIZE = 6


def summary_batches(rows: DataFrame, keys: list[str], order: list[str],
                    size: int = BATCH_SIZE, out: str = "batch_no") -> DataFrame:
    """Number rows in batches of ``size`` per ``keys`` in ``order`` (unique
    within the keys; none of them null). Only those columns are numbered; the
    rows are joined back."""
    n = keyed_ordinal(rows.select(*keys, *order), keys, order, out="_rn")
    n = n.withColumn(out, F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")
    return rows.join(n, [*keys, *order])


def first_sentence_summaries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Test hook standing in for a summariser: the first sentence of the
    content (up to and including the first '.'), stripped."""
    text = pdf["content"].fillna("")
    first = text.str.extract(r"^([^.]*\.?)", expand=False).fillna("").str.strip()
    return pd.DataFrame({"id": pdf["id"].astype("int64"), "summary": first})


def enrich_batches(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame],
                   batch_keys: list[str], schema: str = "id long, summary string", errors: bool = False) -> DataFrame:
    """Call ``fn`` once per batch (rows of equal ``batch_keys``). With
    ``errors`` there is a column ``error`` too: a batch whose call raises gives
    its ids with the error's text and no summary, and the others go on;
    otherwise the error ends the job."""
    dealt = rows.repartition(*batch_keys).sortWithinPartitions(*batch_keys)

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        if not errors:
            return fn(batch)
        try:
            return fn(batch).assign(error=None)
        except Exception as e:  # the user's function: any error is its batch's answer
            return pd.DataFrame({"id": batch["id"], "summary": None, "error": f"{type(e).__name__}: {e}"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            if rest is not None and len(rest):
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            number = (pdf[batch_keys] != pdf[batch_keys].shift()).any(axis=1).cumsum()
            last = number == number.iloc[-1]  # goes on in the next frame, maybe
            rest = pdf[last]
            for _, batch in pdf[~last].groupby(number[~last], sort=False):
                yield call(batch.reset_index(drop=True))
        if rest is not None and len(rest):
            yield call(rest.reset_index(drop=True))

    return dealt.mapInPandas(run, schema + (", error string" if errors else ""))


def apply_summaries(pending: DataFrame, summaries: DataFrame, id_col: str = "id",
                    col: str = "summary_tr") -> DataFrame:
    """Left join of new summaries; matched rows take the new text."""
    s = summaries.select(F.col("id").alias("_sid"), F.col("summary").alias("_new"))
    j = pending.join(s, F.col(id_col) == F.col("_sid"), "left")
    return j.withColumn(col, F.coalesce(F.col("_new"), F.col(col))).drop("_sid", "_new")
