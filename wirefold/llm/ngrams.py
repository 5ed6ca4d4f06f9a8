"""A character n-gram model that stays sharded: interpolated modified
Kneser-Ney of order ``ORDER`` over all code points, trained and looked up by
joins.

A symbol is a code point + 2 (``START`` before a text, 0 for none), so an
n-gram of up to six symbols is exact in two longs of 63 bits, whatever the
script; the zeros tell its length. No table of the model is collected, and only
those of single symbols (at most one row per code point) are broadcast.

Scoring: the distinct n-grams of all texts are looked up once. Those the model
has are done after one join; the others go on with their shorter ending and the
weight of the context, so each round has fewer rows. Then texts are dealt into
groups of about ``GROUP_CHARS`` characters. Each group asks once for each
distinct n-gram of six symbols, gets one number for it and sums by text. Half
of the groups are scored at a time, so that less is on disk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.llm import common

ORDER, BITS, START = 6, 21, 1
#: Characters of a group of texts, and symbols worked on at a time.
GROUP_CHARS, BATCH_SYMBOLS = 32_000_000, 1_000_000
#: Distinct n-grams that a task holds before it passes them on.
HELD_NGRAMS = 1_500_000
#: Parts in which groups are scored, one after another, so that the shuffled rows of one are gone before the next.
SCORED_PARTS = 2
#: Symbols that a packed key can tell apart: ``ORDER`` of them fit in 60 bits.
LOCAL_BITS = 10
#: Bytes of texts that a Python worker is sent at a time.
SENT_BYTES = 4 << 20

stored = partial(common.stored, sent_bytes=SENT_BYTES)


def _batches(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BATCH_SYMBOLS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _line(texts: list[str]):
    """(symbols with the starts of each text, which of them are characters, lengths)."""
    import numpy as np

    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    pad, at = ORDER - 1, 0
    line = np.full(int(lengths.sum()) + pad * len(parts), START, dtype=np.int32)
    real = np.zeros(len(line), dtype=bool)
    for p in parts:
        at += pad
        line[at:at + len(p)] = p
        line[at:at + len(p)] += 2
        real[at:at + len(p)] = True
        at += len(p)
    return line, real, lengths


def _distinct(keys):
    """Sorted distinct values, by a sort: numpy's own hashes them, at nine times the cost."""
    import numpy as np

    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _bits(own) -> int:
    """Bits of a packed key for each of its symbols."""
    return max(1, (len(own) - 1).bit_length())


def _segments(line, real):
    """(keys of the n-grams at the characters, symbols by rank): pieces of the
    line with few enough symbols for packed keys; a piece of 2^LOCAL_BITS
    symbols always has."""
    import numpy as np

    own = np.flatnonzero(np.bincount(line)) if len(line) else np.zeros(0, dtype=np.int64)
    if len(own) > 1 << LOCAL_BITS:
        half = max(ORDER, len(line) // 2)
        yield from _segments(line[:half], real[:half])
        rest = real[half - ORDER + 1:].copy()
        rest[:ORDER - 1] = False
        yield from _segments(line[half - ORDER + 1:], rest)
        return
    if not len(own):
        return
    rank = np.zeros(int(own[-1]) + 1, dtype=np.int64)
    rank[own] = np.arange(len(own))
    ranks, bits = rank[line], _bits(own)
    key = ranks.copy()
    for back in range(1, ORDER):
        key[back:] |= ranks[:-back] << (bits * back)
    yield key[real], own


def _ordered(keys, own):
    """(``keys`` in ascending order, where each was): one sort of numbers that
    hold both, if they fit in 63 bits."""
    import numpy as np

    room = len(keys).bit_length()
    if ORDER * _bits(own) + room > 63:
        order = np.argsort(keys)
        return keys[order], order
    both = keys << room
    both |= np.arange(len(keys))
    both.sort()
    return both >> room, both & ((1 << room) - 1)


def _unpack(keys, own):
    """(hi, lo) of packed keys, a slice at a time, so that little is held beside them."""
    import numpy as np

    hi, lo = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    bits, rows = _bits(own), 100_000
    for at in range(0, len(keys), rows):
        part = keys[at:at + rows]
        for back in range(ORDER):
            symbol = own[(part >> (bits * back)) & ((1 << bits) - 1)]
            (lo if back < 3 else hi)[at:at + rows] |= symbol << (BITS * (back % 3))
    return hi, lo


def _repacked(keys, own, to):
    """Packed keys by the ranks of ``to``, which has all symbols of ``own``; their order stays."""
    import numpy as np

    if len(own) == len(to):
        return keys
    ranks, bits, more, out = np.searchsorted(to, own), _bits(own), _bits(to), np.zeros(len(keys), dtype=np.int64)
    for back in range(ORDER):
        out |= ranks[(keys >> (bits * back)) & ((1 << bits) - 1)] << (more * back)
    return out


def _summed(parts: list):
    """(hi, lo, n) or (packed keys, n) of several such, each n-gram once.
    ``parts`` is emptied, and columns are ordered one after another, so that
    few copies are held at once."""
    import numpy as np

    columns = [*zip(*parts, strict=True)]
    parts.clear()
    for i in range(len(columns)):
        columns[i] = np.concatenate(columns[i])
    *keys, n = columns
    del columns
    order = np.lexsort(keys[::-1])
    for i in range(len(keys)):
        keys[i] = keys[i][order]
    n = n[order]
    del order
    new = np.ones(len(n), dtype=bool)
    new[1:] = reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))
    first = np.flatnonzero(new)
    return (*(k[first] for k in keys), np.add.reduceat(n, first) if len(first) else n)


def _counted(texts: Iterator[str], held: int | None = None):
    """(hi, lo, n) of the n-grams of ``texts``, each once; passed on, and begun
    anew, whenever there are more than ``held``. They are held as packed keys of
    all symbols ``seen``, in two thirds of the bytes; those of a piece with whose
    symbols these would be too many are held as they are passed on."""
    import numpy as np

    seen, packed, wide = np.zeros(0, dtype=np.int64), [], []  # the first of each is what is summed, if anything is
    had, size = 0, 0

    def passed_on():
        parts = [_summed(wide)] if wide else []
        if packed:
            keys, n = _summed(packed)
            parts.append((*_unpack(keys, seen), n))
        return parts[0] if len(parts) == 1 else _summed(parts)

    for part in _batches(texts):
        line, real, _ = _line(part)
        for keys, own in _segments(line, real):
            keys.sort()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
            n, keys = np.diff(np.r_[first, len(keys)]), keys[first]
            size += len(first)
            both = np.union1d(seen, own)
            if len(both) > 1 << LOCAL_BITS:
                wide.append((*_unpack(keys, own), n))
                continue
            packed = [(_repacked(k, seen, both), m) for k, m in packed]
            seen = both
            packed.append((_repacked(keys, own, seen), n))
        del line, real
        if size > max(had // 2, BATCH_SYMBOLS):
            packed, wide = ([_summed(parts)] if parts else [] for parts in (packed, wide))
            had, size = sum(len(parts[0][0]) for parts in (packed, wide) if parts), 0
            if held is not None and had > held:
                yield passed_on()
                had, seen = 0, np.zeros(0, dtype=np.int64)
    yield passed_on() if packed or wide else tuple(np.zeros(0, dtype=np.int64) for _ in range(3))


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(hi, lo, n) of length ``ORDER`` over all rows of the column ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _counted((t.as_py() or "" for batch in batches for t in batch.column(0)), HELD_NGRAMS):
            yield from _sliced(found)

    return texts.select("text").mapInArrow(run, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def distinct_ngrams(texts: DataFrame) -> DataFrame:
    """(hi, lo) of length ``ORDER`` that are in the column ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _counted((t.as_py() or "" for batch in batches for t in batch.column(0)), HELD_NGRAMS):
            yield from _sliced(found[:2])

    return texts.select("text").mapInArrow(run, "hi long, lo long").distinct()


def _sliced(columns, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + rows]) for c in columns], names=["hi", "lo", "n"][:len(columns)])


class Found:
    """The log-probabilities of the n-grams that a group has asked for, and of its texts."""

    def __init__(self, hi, lo, lp):
        import numpy as np

        self.his, self.los = _distinct(hi), _distinct(lo)
        at = self._place(hi, lo)
        order = np.argsort(at)
        self.known, self.lp = at[order], lp[order]

    def _place(self, hi, lo):
        import numpy as np

        return np.searchsorted(self.his, hi) << 32 | np.searchsorted(self.los, lo)

    def log_probabilities(self, texts: list[str]):
        """The sum over each text's characters."""
        import numpy as np

        line, real, lengths = _line(texts)
        logs = [np.zeros(0)]
        for keys, own in _segments(line, real):
            keys, order = _ordered(keys, own)  # one sort finds the distinct ones and where each of them is
            new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, dtype=bool)
            values = self.lp[np.searchsorted(self.known, self._place(*_unpack(keys[new], own)))].astype(np.float64)
            keys = np.empty(len(order))
            keys[order] = np.repeat(values, np.diff(np.r_[np.flatnonzero(new), len(order)]))
            logs.append(keys)
        ends = np.r_[0.0, np.cumsum(np.concatenate(logs))]
        return np.diff(ends[np.r_[0, np.cumsum(lengths)]])


def _suffix(length: int) -> tuple[Column, Column]:
    """The last ``length`` symbols of the n-gram in hi, lo."""
    cut = lambda c, k: F.col(c).bitwiseAND(F.lit((1 << (BITS * max(0, min(3, k)))) - 1))
    return cut("hi", length - 3).alias("hi"), cut("lo", length).alias("lo")


def _context(length: int) -> tuple[Column, Column]:
    """Those symbols without the last."""
    hi, lo = _suffix(length)
    last = hi.bitwiseAND(F.lit((1 << BITS) - 1))
    return F.shiftright(hi, BITS).alias("chi"), F.shiftright(lo, BITS).bitwiseOR(F.shiftleft(last, 2 * BITS)).alias("clo")


def _part(model: DataFrame, kind: str, length: int, value: str) -> DataFrame:
    """(chi, clo, value) of one kind and length. Of single symbols, and of none,
    there is at most one row per code point: those are broadcast."""
    rows = (model.filter((F.col("kind") == kind) & (F.col("length") == length))
            .select(F.col("hi").alias("chi"), F.col("lo").alias("clo"), F.col("value").alias(value)))
    return F.broadcast(rows) if length < 2 else rows


def _joined(rows: DataFrame, part: DataFrame, key: tuple[Column, Column], how: str) -> DataFrame:
    return rows.withColumns({"chi": key[0], "clo": key[1]}).join(part, ["chi", "clo"], how).drop("chi", "clo")


def train(texts: DataFrame, discounts) -> tuple[DataFrame, int]:
    """The model of the column ``text``, (kind, length, hi, lo, value) over
    stored tables, and its number of symbols. A row of kind 'p' is an n-gram's
    probability after its context, interpolated down to the uniform one; one of
    kind 'w' is the weight that a context gives to the next shorter n-gram.
    Lengths below ``ORDER`` have continuation counts. ``discounts`` gives the
    three discounts of a table of counts."""
    tables = {ORDER: stored(count_ngrams(texts), "kn-counts")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = stored(tables[k + 1].groupBy(*_suffix(k)).agg(F.count(F.lit(1)).alias("n")), "kn-counts")
    symbols, model = tables[1].count(), None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[k])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        grams = tables[k].withColumn("cut", cut)
        held = stored(grams.groupBy(*_context(k)).agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight")), "kn-weights")
        known = _joined(grams, F.broadcast(held) if k < 3 else held, _context(k), "inner")
        low = F.lit(1.0 / (symbols + 1))
        if k > 1:
            known, low = _joined(known, _part(model, "p", k - 1, "low"), _suffix(k - 1), "inner"), F.col("low")
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * low
        known = stored(known.select("hi", "lo", p.cast("float").alias("value")), "kn-shares")
        rows = [known.select(F.lit("p").alias("kind"), F.lit(k).alias("length"), "hi", "lo", "value"),
                held.select(F.lit("w").alias("kind"), F.lit(k - 1).alias("length"), F.col("chi").alias("hi"),
                            F.col("clo").alias("lo"), F.col("weight").cast("float").alias("value"))]
        model = rows[0].unionAll(rows[1]) if model is None else model.unionAll(rows[0]).unionAll(rows[1])
    return model, symbols


def look_up(grams: DataFrame, model: DataFrame, symbols: int) -> DataFrame:
    """``grams`` (hi, lo; distinct, of length ``ORDER``) with the natural
    logarithm ``lp`` of their probability: that of the longest ending that the
    model has, times the weights of the longer contexts that it has."""
    wait, done = grams.withColumn("weight", F.lit(1.0)), None
    for k in range(ORDER, 0, -1):
        step = stored(_joined(wait, _part(model, "p", k, "p"), _suffix(k), "left"), "kn-looked-up")
        found = step.filter("p IS NOT NULL").select("hi", "lo", F.log(F.col("weight") * F.col("p")).cast("float").alias("lp"))
        done = found if done is None else done.unionAll(found)
        wait = (_joined(step.filter("p IS NULL"), _part(model, "w", k - 1, "w"), _context(k), "left")
                .select("hi", "lo", (F.col("weight") * F.coalesce("w", F.lit(1.0))).alias("weight")))
    return done.unionAll(wait.select("hi", "lo", F.log(F.col("weight") / F.lit(symbols + 1.0)).cast("float").alias("lp")))


def score(rows: DataFrame, model: DataFrame, symbols: int, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``rows`` without the column ``text``, with its log-probability ``lp``
    (null for null and empty texts)."""
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_chars))  # by size alone: more groups would ask for more rows
    looked_up = stored(look_up(distinct_ngrams(rows.select("text").coalesce(groups)), model, symbols), "kn-scores")
    keys = [c for c in rows.columns if c != "text"]
    dealt = rows.withColumn("__group", F.pmod(F.xxhash64(*rows.columns), F.lit(groups)).cast("int"))
    schema = T.StructType([rows.schema[c] for c in keys]).add("lp", "double")

    def ask(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = next(_counted(t.as_py() or "" for batch in batches for t in batch.column("text")))
        pa.default_memory_pool().release_unused()  # a worker that waits holds none of an earlier group
        for part in _sliced(found[:2]):
            yield part.add_column(0, "__group", pa.array([key[0].as_py()] * part.num_rows, pa.int32()))

    def judge(group: pa.Table, got: pa.Table) -> pa.Table:
        found, lp = Found(*(got.column(c).to_numpy() for c in ("hi", "lo", "lp"))), []
        del got
        pa.default_memory_pool().release_unused()
        for part in _batches(t.as_py() or "" for t in group.column("text")):
            lp += [v if t else None for t, v in zip(part, found.log_probabilities(part).tolist(), strict=True)]
        return pa.table([*(group.column(c) for c in keys), pa.array(lp, pa.float64())], names=[*keys, "lp"])

    def part(dealt: DataFrame) -> DataFrame:
        asked = dealt.groupBy("__group").applyInArrow(ask, "__group int, hi long, lo long")
        got = asked.join(looked_up.hint("shuffle_merge"), ["hi", "lo"]).select("__group", "hi", "lo", "lp")
        return stored(dealt.groupBy("__group").cogroup(got.groupBy("__group")).applyInArrow(judge, schema), "scores")

    parts = min(groups, SCORED_PARTS)
    scored = [part(dealt.filter(F.col("__group") % parts == i) if parts > 1 else dealt) for i in range(parts)]
    return reduce(DataFrame.unionAll, scored)
