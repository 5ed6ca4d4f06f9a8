"""Conversation structure repair by integer-minimum dynamic programming.

The edits of a conversation are a path through a directed acyclic graph whose
nodes are (rows read, role state). One integer is the weight of a path: its
high digits are the cost, its low digits, base 5 and of fixed width, the audit
letters from the left (D 1, I 2, K 3, R 4), zeros filling the end. The smallest
integer is thus the cheapest path with the ASCII-least audit, and a plain
minimum decides everything. (Two audits of one node and one cost are never
prefixes of each other: the longer one would have further inserts, which cost.
So the minimum at a node stays the minimum whatever follows.)

Rows are numbered within their conversation by a range sort and cut into
segments of ``SEGMENT`` rows. A segment alone gives the cheapest path from each
role state to each other; conversations longer than a segment are put together
from those tables in rounds of ``FAN`` neighbours, so no task ever holds the
rows of a long conversation. Only the SHA-256 of the whole repaired text, which
cannot be taken in parts, passes a conversation's segments through one task,
one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm.common import stored, table
from wirefold.operators.ordinal import keyed_ordinal

SEGMENT, FAN = 64, 16
#: The costs and the digits of the edits, as the task fixes them.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BASE, LETTERS = 5, " DIKR"
#: States: nothing yet, after system, after user, after assistant. Each allows one of user and assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ALLOWED = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
NAMES = {"u": "user", "a": "assistant"}
#: Inserts that complete a conversation from each state.
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
WHITE = " \t\n\x0b\x0c\r"


def _least_paths(codes: str, start: int, whole: bool) -> dict[int, tuple[int, str]]:
    """State -> (cost, audit) of the cheapest edits of the rows ``codes`` from
    ``start``; with ``whole`` inserts may follow the last row.

    A code is d (must be deleted) or the row's initial s, u, a, x (any other),
    in upper case if the row is truncated."""
    width = 3 * len(codes) + 2
    place = [BASE ** i for i in range(width + 1)]
    unit = place[width]
    best: dict[int, tuple[int, int]] = {start: (0, 0)}  # state -> (integer, letters in it)

    def weigh(into: dict, state: int, at: tuple[int, int], cost: int, letter: int) -> bool:
        value = at[0] + cost * unit + letter * place[width - 1 - at[1]]
        if state in into and into[state][0] <= value:
            return False
        into[state] = value, at[1] + 1
        return True

    def inserts() -> None:
        again = True
        while again:
            again = False
            for state in list(best):
                again |= weigh(best, ALLOWED[state][1], best[state], INSERT, 2)

    for code in codes:
        inserts()
        after: dict[int, tuple[int, int]] = {}
        extra, initial = (TRUNCATED if code.isupper() else 0), code.lower()
        for state, at in best.items():
            weigh(after, state, at, DELETE, 1)
            if initial != "d":
                allowed, follows = ALLOWED[state]
                if initial == allowed:
                    weigh(after, follows, at, extra, 3)
                elif initial == "s" and state == START:
                    weigh(after, SYSTEM, at, extra, 3)
                weigh(after, follows, at, REROLE + extra, 4)
        best = after
    if whole:
        inserts()
    found = {}
    for state, (value, letters) in best.items():
        cost, digits = divmod(value, unit)
        found[state] = cost, "".join(LETTERS[digits // place[width - 1 - i] % BASE] for i in range(letters))
    return found


@lru_cache(maxsize=50_000)
def whole_repair(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    found = _least_paths(codes, START, True)
    return min(found[s] for s in (START, ASSISTANT) if s in found)


@lru_cache(maxsize=5_000)
def segment_table(codes: str) -> list[dict]:
    """The cheapest paths of a segment from every state to every state. The
    audit of a segment starts with its first state as a digit."""
    return [{"i": i, "o": o, "cost": cost, "audit": f"{i}{audit}"}
            for i in ALLOWED for o, (cost, audit) in _least_paths(codes, i, False).items()]


_PLAIN = str.maketrans("", "", "0123,")


def joined_tables(tables: list[list[dict]]) -> list[dict]:
    """The table of neighbouring segments as one; their audits are joined by commas."""
    have = {(c["i"], c["o"]): (c["cost"], c["audit"]) for c in tables[0]}
    for cells in tables[1:]:
        found: dict[tuple[int, int], tuple[int, str]] = {}
        for (i, via), (cost, audit) in have.items():
            for c in cells:
                if c["i"] == via:
                    one = cost + c["cost"], f"{audit},{c['audit']}"
                    old = found.get((i, c["o"]))
                    if old is None or (one[0], one[1].translate(_PLAIN)) < (old[0], old[1].translate(_PLAIN)):
                        found[i, c["o"]] = one
        have = found
    return [{"i": i, "o": o, "cost": cost, "audit": audit} for (i, o), (cost, audit) in have.items()]


def finished(cells: list[dict]) -> tuple[int, str]:
    """(cost, audit by segments) of a whole conversation from its table."""
    ends = [(c["cost"] + INSERT * TAIL[c["o"]], c["audit"] + "I" * TAIL[c["o"]]) for c in cells if c["i"] == START]
    return min(ends, key=lambda e: (e[0], e[1].translate(_PLAIN)))


def edited_lines(audit: str, state: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The rows that an audit leaves: edit, role and text of each."""
    lines, rows = [], zip(roles, texts, strict=True)
    for edit in audit:
        initial, follows = ALLOWED[state]
        if edit == "I":
            lines.append({"edit": edit, "role": NAMES[initial], "text": ""})
            state = follows
            continue
        role, text = next(rows)
        if edit == "K":
            lines.append({"edit": edit, "role": role, "text": text})
            state = follows if role[:1] == initial else SYSTEM
        elif edit == "R":
            lines.append({"edit": edit, "role": NAMES[initial], "text": text})
            state = follows
    return lines


CELLS = "array<struct<i:int,o:int,cost:long,audit:string>>"
LINES = "array<struct<edit:string,role:string,text:string>>"
_CELLS = pa.list_(pa.struct([("i", pa.int32()), ("o", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_LINES = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments -> their tables; a segment that is a whole conversation gets its cost, audit and lines at once."""
    for batch in batches:
        cells, cost, audit, lines = [], [], [], []
        codes, whole = batch.column("codes").to_pylist(), batch.column("whole").to_pylist()
        for row, (code, alone) in enumerate(zip(codes, whole, strict=True)):
            if alone:
                c, a = whole_repair(code)
                cells.append(None)
                lines.append(edited_lines(a, START, batch.column("roles")[row].as_py(), batch.column("texts")[row].as_py()))
            else:
                c = a = None
                cells.append(segment_table(code))
                lines.append(None)
            cost.append(c)
            audit.append(a)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(cells, _CELLS), pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(lines, _LINES)],
            names=[*batch.schema.names, "cells", "cost", "audit", "lines"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [joined_tables(tables) for tables in batch.column("tables").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, _CELLS)], names=[*batch.schema.names[:-1], "cells"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [finished(cells) for cells in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("ck"), pa.array([c for c, _ in ends], pa.int64()), pa.array([a for _, a in ends], pa.string())],
            names=["ck", "cost", "by_segment"])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [edited_lines(a[1:], int(a[0]), batch.column("roles")[row].as_py(), batch.column("texts")[row].as_py())
                 for row, a in enumerate(batch.column("piece").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("ck"), batch.column("seg"), pa.array(lines, _LINES)], names=["ck", "seg", "lines"])


def _stream_sha256(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ck, chunk) rows in order -> SHA-256 of each ck's chunks joined by newlines; null chunks have no line."""
    key, digest, begun, out = None, None, False, []
    for batch in batches:
        for row in range(batch.num_rows):
            ck, chunk = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            if ck != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest, begun = ck, hashlib.sha256(), False
            if chunk is not None:
                digest.update(("\n" if begun else "").encode() + chunk.encode())
                begun = True
    if key is not None:
        out.append((key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())],
                                     names=["ck", "repaired_sha256"])


def conversation_key(conv_id: Column) -> Column:
    """A key that is never null, another one for a null id than for any id."""
    return F.when(conv_id.isNull(), "n").otherwise(F.concat(F.lit("k"), conv_id.cast("string")))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with damage by crc32(`conv_id:turn`) % 20:
    0 drops the row, 1 empties its text, 2 removes `.!?`, 3 repeats it, 4 makes
    its role user. Nulls are one space in the key, as roles and as texts."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return (rows.filter(kind != 0)
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
            .drop("_copy"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ck, at (0-based place in the conversation) and digest. Order: turn, nulls first, then role and the text's digest."""
    keyed = rows.select(conversation_key(F.col("conv_id")).alias("ck"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text")).withColumn("text_digest", F.sha2("text", 256))
    return (keyed_ordinal(keyed, ["ck"], [F.col("turn").asc_nulls_first(), "role", "text_digest"], out="rn")
            .withColumn("at", F.col("rn") - 1).drop("rn"))


def _segments(rows: DataFrame) -> DataFrame:
    """One row per segment, written to the shared folder: codes, roles, texts,
    counts of faults, and what ``_solve`` finds."""
    firsts = (rows.groupBy("ck", "role", "text_digest").agg(F.min("at").alias("at"))
              .select(F.col("ck").alias("f_ck"), F.col("at").alias("f_at")))
    # (ck, at) is unique on both sides: no key is hot
    seen = rows.join(firsts, (F.col("ck") == F.col("f_ck")) & (F.col("at") == F.col("f_at")), "left")
    visible = F.rtrim("text", F.lit(WHITE))
    last = F.substring(visible, -1, 1)
    fault = (F.when(visible == "", "blank").when(F.col("f_at").isNull(), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated").otherwise(""))
    initial = F.substring("role", 1, 1)
    marked = seen.select("ck", F.expr(f"at div {SEGMENT}").alias("seg"), "at", "role", "text", initial.alias("initial"), fault.alias("fault"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").otherwise(F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x"))
    row = F.struct("at", "role", "text", "initial", "fault", F.when(F.col("fault") == "truncated", F.upper(code)).otherwise(code).alias("code"))
    pairs = F.transform(F.slice("r", 2, SEGMENT), lambda x, i: F.concat(F.get("r", i)["initial"], x["initial"]))
    count = lambda kind: F.size(F.filter("r", lambda x: x["fault"] == kind)).cast("long").alias(kind)
    part = lambda name: F.transform("r", lambda x: x[name])
    segments = (marked.groupBy("ck", "seg").agg(F.array_sort(F.collect_list(row)).alias("r"))
                .select("ck", "seg", part("role").alias("roles"), part("text").alias("texts"),
                        F.array_join(part("code"), "").alias("codes"),
                        ((F.col("seg") == 0) & (F.size("r") < SEGMENT)).alias("whole"),
                        count("blank"), count("duplicate"), count("truncated"),
                        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
                        F.get("r", F.lit(0))["initial"].alias("first"), F.element_at("r", -1)["initial"].alias("last")))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in segments.schema.fields)}, cells {CELLS}, cost long, audit string, lines {LINES}"
    return stored(segments.mapInArrow(_solve, schema), "repair-segments")


def _long_conversations(segments: DataFrame) -> DataFrame:
    """(ck, cost, by_segment) of conversations of several segments."""
    parts = segments.filter(~F.col("whole")).select("ck", "seg", "cells")
    last = parts.agg(F.max("seg")).first()[0] or 0
    while last > 0:
        parts = (parts.groupBy("ck", F.expr(f"seg div {FAN}").alias("seg"))
                 .agg(F.array_sort(F.collect_list(F.struct("seg", "cells"))).alias("tables"))
                 .select("ck", "seg", F.transform("tables", lambda t: t["cells"]).alias("tables"))
                 .mapInArrow(_combine, f"ck string, seg long, cells {CELLS}"))
        parts = stored(parts, "repair-tables")
        last //= FAN
    return parts.mapInArrow(_finish, "ck string, cost long, by_segment string")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired rows) of rows (conv_id, turn, role, text).

    conversations: ck, blank, duplicate, truncated, illegal, cost, audit.
    repaired: ck, seg, lines, whole: for each segment of a conversation the
    array of (edit, role, text) in order, edit being K, R or I; whole is true
    if the segment is all of its conversation.

    A row's fault is the first of blank (no visible character), duplicate (role
    and text seen earlier) and truncated (last visible character is no `.!?`).
    Null roles and texts count as one space; a null conv_id is a conversation
    of its own. Rows of one turn are ordered by role and the SHA-256 of their
    text, null turns come first; repeated rows are duplicates. A role that
    starts with none of s, u, a (an empty one too) can't be kept. Texts and
    conversations of any length are whole; an empty table gives no rows;
    further columns aren't read.
    """
    segments = _segments(_numbered(rows))
    long = stored(_long_conversations(segments), "repair-long")
    pieces = long.select("ck", F.posexplode(F.split("by_segment", ",")).alias("seg", "piece"))
    edited = (segments.filter(~F.col("whole")).select("ck", "seg", "roles", "texts")
              .join(pieces.withColumn("seg", F.col("seg").cast("long")), ["ck", "seg"])
              .mapInArrow(_edit, f"ck string, seg long, lines {LINES}"))
    repaired = (segments.filter("whole").select("ck", "seg", "lines", "whole")
                .unionAll(edited.withColumn("whole", F.lit(False))))
    short = segments.filter("whole").select("ck", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    parts = segments.filter(~F.col("whole")).select("ck", "seg", "blank", "duplicate", "truncated", "illegal", "first", "last")
    border = parts.select("ck", (F.col("seg") + 1).alias("seg"), F.col("last").alias("border"))
    sums = (parts.join(border, ["ck", "seg"], "left")
            .groupBy("ck").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
                               (F.sum("illegal") + F.count_if(~F.concat("border", "first").isin("su", "ua", "au"))).alias("illegal"))
            .join(long, "ck").select("ck", "blank", "duplicate", "truncated", "illegal", "cost",
                                     F.translate("by_segment", "0123,", "").alias("audit")))
    return short.unionAll(sums), repaired


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(ck, repaired_sha256) of each conversation's `role:text` lines. Only
    conversations of several segments are shuffled."""
    chunk = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"))
    parts = repaired.select("ck", "seg", "whole", chunk.alias("chunk"))
    alone = parts.filter("whole").select("ck", F.sha2(F.coalesce("chunk", F.lit("")), 256).alias("repaired_sha256"))
    return alone.unionAll(parts.filter(~F.col("whole")).repartition("ck").sortWithinPartitions("ck", "seg")
                          .select("ck", "chunk").mapInArrow(_stream_sha256, "ck string, repaired_sha256 string"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(given)
    conversations, repaired = repair_conversations(rows)
    turns = (rows.groupBy(conversation_key(F.col("conv_id")).alias("t_ck"), "turn").agg(F.lit(1).alias("one"))
             .groupBy("t_ck").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")))
    digests = repaired_digests(repaired).withColumnRenamed("ck", "d_ck")
    found = (conversations.join(digests, F.col("ck") == F.col("d_ck")).join(turns, F.col("ck") == F.col("t_ck")))
    original = given.select("conv_id").distinct().withColumn("o_ck", conversation_key(F.col("conv_id")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (original.join(found, F.col("o_ck") == F.col("ck"), "left")
            .select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))
