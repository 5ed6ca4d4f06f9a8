"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its
labelled text. A text is parsed greedily into the longest phrases that occur
in that sample; the language that needs the fewest phrases, each weighted by
the binary logarithm of the sample's length and divided by the text's length,
wins. Letters are lower-cased and every run of other characters is one space.

The sample is bounded by documented parameters and chosen by a hash of the
identifier; prediction reads every whole text in one narrow pass. Texts are
parsed in blocks of ``BLOCK`` symbols, all blocks of a batch side by side: first
each from the automaton's start, then again those that the block before them
leaves in another state, until none is. So phrases run across blocks, and the
counts are those of one parse from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirefold.llm.common import table

#: Bounds of the sample: documents and characters of a language, and characters
#: of all languages together (at least one character of each).
TRAIN_DOCS, TRAIN_CHARS, TRAIN_TOTAL = 48, 40_000, 800_000
#: Cells up to which an automaton's transitions are a dense table.
DENSE_CELLS = 1 << 23
#: Symbols of a block, and characters that are parsed at a time.
BLOCK, BATCH_CHARS = 256, 3_000_000

PAD, SPACE, OTHER, FIRST = 0, 1, 2, 3


@lru_cache(maxsize=1)
def letter_table():
    """For each code point the lower-cased letter's code point, 0 where it is no letter."""
    import numpy as np

    out = np.zeros(0x110000, dtype=np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the empty one."""
    nxt, link, size, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """Phrase counts of texts against the sample of each language."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        import numpy as np

        self.langs = [lang for lang, _ in samples]
        letters = letter_table()
        own = np.unique(np.concatenate([np.zeros(0, np.int32), *(letters[code_points(text)] for _, text in samples)]))
        own = own[own > 0]
        rank = np.full(0x110000, OTHER, dtype=np.int32)
        rank[own] = np.arange(FIRST, FIRST + len(own), dtype=np.int32)
        rank[0] = SPACE
        self.symbol_of = rank[letters]  # letters[i] is 0 for all that is no letter
        self.width = FIRST + len(own)
        self.tables, self.weights = [], []
        for _, text in samples:
            symbols = self.symbols(text)
            self.tables.append(self._automaton(symbols))
            self.weights.append(max(1.0, float(np.log2(max(2, len(symbols))))))

    def _automaton(self, symbols):
        """(column of each symbol, width, dense steps, sparse transitions): a
        language's columns are PAD, what its sample lacks, and each of its symbols."""
        import numpy as np

        present = np.unique(symbols)
        column = np.ones(self.width, dtype=np.int32)
        column[PAD] = 0
        column[present] = np.arange(2, 2 + len(present), dtype=np.int32)
        width = 2 + len(present)
        states = suffix_automaton(column[symbols].tolist())
        if len(states) * width > DENSE_CELLS:
            moves = sorted((i * width + c, to) for i, row in enumerate(states) for c, to in row.items())
            keys, to = (np.array(x, dtype=np.int64) for x in zip(*moves, strict=True))
            start = np.zeros(width, dtype=np.int64)
            start[list(states[0])] = list(states[0].values())
            return column, width, None, (keys, to, start)
        table_ = np.full((len(states), width), -1, dtype=np.int32)
        for i, row in enumerate(states):
            for c, to in row.items():
                table_[i, c] = to
        start = np.maximum(table_[0], 0)  # a symbol that never occurs is a phrase by itself
        # value: four times the offset of the next state's row, plus the phrases that end
        # at this symbol: the one before it, and the symbol itself if the sample lacks it
        ends, lacks = table_ < 0, (table_[0] < 0).astype(np.int32)
        step = np.where(ends, start * width * 4 + 1 + lacks, table_ * width * 4)
        step[0] = start * width * 4 + lacks
        step[:, PAD] = np.arange(len(states)) * width * 4
        return column, width, step.astype(np.int32).ravel(), None

    @staticmethod
    def _sparse_counts(columns, state, column, width: int, keys, to, start):
        """(phrases that end in each block, states after it) from the states before it."""
        import numpy as np

        count = np.zeros(columns.shape[1], dtype=np.int32)
        for symbols in columns:
            c = column.take(symbols)
            asked = state * width + c
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            ends, real = keys[at] != asked, c != PAD
            count += real & ends & (state > 0)
            count += c == 1
            state = np.where(real, np.where(ends, start[c], to[at]), state)
        return count, state

    @staticmethod
    def _dense_counts(columns, state, column, step):
        import numpy as np

        count = np.zeros(columns.shape[1], dtype=np.int32)
        for c in columns:
            value = step.take(state + column.take(c))
            count += value & 3
            state = value >> 2
        return count, state

    def symbols(self, text: str):
        import numpy as np

        out = self.symbol_of[code_points(text)]
        blank = out == SPACE
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        return out[np.asarray(keep)]

    def costs(self, texts: list[str]):
        """(costs by text and language, lengths in symbols, whether there is a letter)."""
        import numpy as np

        parts = [self.symbols(t) for t in texts]
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        letters = np.array([bool((p > SPACE).any()) for p in parts], dtype=bool)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        grid = np.zeros((len(owner), BLOCK), dtype=np.int32)
        row = 0
        for p, n in zip(parts, blocks.tolist(), strict=True):
            grid[row:row + n].reshape(-1)[:len(p)] = p
            row += n
        columns = np.ascontiguousarray(grid.T)
        out = np.zeros((len(texts), len(self.langs)))
        first = np.ones(len(owner), dtype=bool)
        first[1:] = owner[1:] != owner[:-1]
        for j, ((column, width, step, sparse), weight) in enumerate(zip(self.tables, self.weights, strict=True)):
            def parse(blocks, before):
                if step is None:
                    return self._sparse_counts(blocks, before, column, width, *sparse)  # noqa: B023
                return self._dense_counts(blocks, before, column, step)  # noqa: B023

            before = np.zeros(len(owner), dtype=np.int64 if step is None else np.int32)
            count, after = parse(columns, before)
            while True:
                # phrases run across blocks: parse again what begins in another state than assumed
                true = np.zeros_like(before)
                true[1:] = np.where(first[1:], 0, after[:-1])
                again = np.flatnonzero(true != before)
                if not len(again):
                    break
                before[again] = true[again]
                count[again], after[again] = parse(columns[:, again], before[again])
            last = np.r_[first[1:], np.ones(min(1, len(owner)), dtype=bool)]
            count = count + (last & (after > 0))  # the phrase that is open at a text's end
            out[:, j] = np.bincount(owner, weights=count, minlength=len(texts)) * weight
        return out / np.maximum(lengths, 1)[:, None], lengths, letters


@lru_cache(maxsize=2)
def parser_for(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str,
                    train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, text) for each learned language, from whole documents in the
    order of a hash of their id until the bound on characters is met (a first
    document that is longer is cut there)."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    langs = labelled.select(lang_col).distinct().count()
    if not langs:
        return ()
    bound = max(1, min(train_chars, TRAIN_TOTAL // langs))
    ids = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"),
                          F.xxhash64(id_col).alias("h"))
    first = Window.partitionBy("lang").orderBy("h", "id")
    chosen = (ids.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= min(train_docs, bound))
              .select(F.col("lang").alias("c_lang"), F.col("id").alias("c_id"), "n"))  # bounded: docs x languages
    rows = (labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"),
                            F.substring(F.col(text_col), 1, bound + 1).alias("text"))
            .join(F.broadcast(chosen), (F.col("lang") == F.col("c_lang")) & (F.col("id") == F.col("c_id"))))
    texts: dict[str, list[str]] = {}
    for r in sorted(rows.select("lang", "n", "text").distinct().collect(), key=lambda r: (r["lang"], r["n"], r["text"])):
        mine = texts.setdefault(r["lang"], [])
        room = bound - sum(map(len, mine))
        if len(r["text"]) <= room or not mine:
            mine.append(r["text"][:bound])
    return tuple(sorted((lang, " ".join(t)) for lang, t in texts.items() if any(c.isalpha() for x in t for c in x)))


def predict_language(docs: DataFrame, samples: tuple[tuple[str, str], ...], keys: list[str],
                     text_col: str = "text") -> DataFrame:
    """``keys`` with lang_pred and score (0 to 1: how much fewer phrases the
    winner needs than the next). Null texts and texts without a letter: ``und``
    and 0; so are all texts if nothing was learned. A single language scores 1.
    Ties go to the language that sorts first."""
    schema = docs.select(*keys).schema.add("lang_pred", "string", False).add("score", "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parser = parser_for(samples) if samples else None

        def predict(texts: list[str]) -> tuple[list[str], list[float]]:
            if parser is None:
                return ["und"] * len(texts), [0.0] * len(texts)
            cost, _, letters = parser.costs(texts)
            best = cost.argmin(axis=1)
            low = np.sort(cost, axis=1)
            lead = 1 - low[:, 0] / np.maximum(low[:, 1], 1e-12) if cost.shape[1] > 1 else np.ones(len(texts))
            return ([parser.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)],
                    np.where(letters, np.clip(lead, 0, 1), 0.0).tolist())

        for batch in batches:
            langs, scores, texts, size = [], [], [], 0
            for t in batch.column(batch.num_columns - 1):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_CHARS:
                    a, b = predict(texts)
                    langs += a
                    scores += b
                    texts, size = [], 0
            if texts:
                a, b = predict(texts)
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return docs.select(*keys, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from documents whose crc32(id as text) mod 3 is not 1; the others
    are held out. A null id is neither learned from nor held out. See
    ``predict_language`` for texts without letters; an empty table gives no
    rows; further columns are not read."""
    rest = F.crc32(F.col(id_col).cast("string")) % 3
    samples = training_sample(docs.filter(rest != 1), id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(rest == 1, F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("__body"))
    return predict_language(slim, samples, ["doc_id", "held_out"], "__body")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
