"""Report texts: source listing and slot listing, cut into message pieces.

A report over all sources is one long text. It is never built in one task:
each line's character offset in the final text comes from a distributed
running sum (see ``ordinal.keyed_ordinal``), each line is cut at the piece
boundaries it crosses, and a piece is assembled from at most ``chunk``
characters. So no group holds more than one message piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import text as T
from wirefold.operators.ordinal import keyed_ordinal

SOURCES_HEADER = "<b>📚 Kaynaklar</b>"   # fixed report header
SLOTS_HEADER = "<b>🕒 Zamanlama Saatleri</b>"  # fixed report header


def source_lines(sources: DataFrame) -> DataFrame:
    """(source_type, id, line) for every source."""
    return sources.select("source_type", "id", T.source_line(
        F.col("id"), F.col("source_type"), F.col("name"), F.col("active"),
        F.col("url"), F.col("x_handle")).alias("line"))


def slot_lines(slots: DataFrame) -> DataFrame:
    """(hour, minute, id, line) for every slot."""
    status = F.when(F.col("active"), F.lit(T.STATUS_ON)).otherwise(F.lit(T.STATUS_OFF))
    return slots.select("hour", "minute", "id", F.concat(
        status, F.lit(" <code>"), F.col("id").cast("string"), F.lit("</code> "),
        T.format_slot(F.col("hour"), F.col("minute"))).alias("line"))


def chunked_report(lines: DataFrame, order: list[str], header: str,
                   chunk: int = T.CHUNK_CHARS) -> DataFrame:
    """Pieces ``(piece_no, piece)`` of ``header + '\\n' + join(lines, '\\n')``
    (lines in ``order``), each ``chunk`` code points except the last."""
    spark = lines.sparkSession
    segs = lines.select(F.lit(1).alias("_grp"), *[F.col(c) for c in order],
                        F.concat(F.lit("\n"), F.col("line")).alias("seg"))
    head = spark.createDataFrame([(header,)], "seg string").select(
        F.lit(0).alias("_grp"), *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order], "seg")
    allsegs = head.unionByName(segs).withColumn("_len", F.length("seg").cast("double"))
    placed = keyed_ordinal(allsegs, [], ["_grp", *order], out="_rn", measure="_len", cum_out="_start")
    placed = placed.withColumn("_start", F.col("_start").cast("long")).withColumn("_len", F.col("_len").cast("long"))
    pieces = placed.filter(F.col("_len") > 0).withColumn("piece_no", F.explode(F.sequence(
        F.floor(F.col("_start") / chunk).cast("long"),
        F.floor((F.col("_start") + F.col("_len") - 1) / chunk).cast("long"))))
    lo = F.greatest(F.col("piece_no") * chunk, F.col("_start"))
    hi = F.least((F.col("piece_no") + 1) * chunk, F.col("_start") + F.col("_len"))
    pieces = pieces.select("piece_no", lo.alias("at"),
                           F.substring(F.col("seg"), (lo - F.col("_start") + 1).cast("int"),
                                       (hi - lo).cast("int")).alias("part"))
    return pieces.groupBy("piece_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))),
                                 lambda x: x["part"]), "").alias("piece"))
