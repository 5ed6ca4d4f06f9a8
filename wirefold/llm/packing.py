"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut into pieces whose lengths are the
binary digits of their number, the largest first, in blocks of at most
``max_tokens``. Each piece is a sequence by itself in the bucket of its
length, so no sequence crosses documents and none needs padding. One narrow
pass over the documents: no shuffle, memory bounded by one Arrow batch.

The vocabulary file is a parameter. Its pre-tokeniser always cuts before a
single space between two printable characters, so a text is split there and
each distinct chunk is encoded once; a bounded cache of them lives as long as
its Python worker. A text that holds one of the tokenizer's special tokens goes
through the tokenizer whole, by its default treatment of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.llm.common import table

MAX_TOKENS = 2048
END_ID = 1
#: Distinct chunks that a worker remembers, and the longest that it does.
CACHE_CHUNKS, CACHE_CHARS = 1_200_000, 48
#: Characters of text that are encoded at a time.
BATCH_CHARS = 2_000_000

SPLIT = re.compile("(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")
PLAIN = re.compile("[!-~¡-ɏ](?:[^ ]*[!-~¡-ɏ])?", re.DOTALL)
#: Chunks that go through the tokenizer as one text, and how its vocabulary writes the byte of a space.
JOINED, SPACE_BYTE = 256, "Ġ"
UNSURE = re.compile("[^ -~\n¡-ɏ]")


def split_text(text: str) -> list[str]:
    """``SPLIT.split(text)``; where every space stands between two printable
    characters, by the faster ``str.split``."""
    if (text and text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text
            and "\n " not in text and not UNSURE.search(text)):
        return text.split(" ")
    return SPLIT.split(text)

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("ids", T.BinaryType(), False),
    T.StructField("doc_tokens", T.LongType(), False),
    T.StructField("bucket", T.IntegerType(), False),
])


class ChunkEncoder:
    """Little-endian 32-bit ids of texts, by the tokeniser at ``path``."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.np = np
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(SPACE_BYTE)]] = True
        self.cache: dict[str, bytes] = {}

    def _encode(self, chunks: list[str]) -> list[bytes]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        line = self.np.fromiter(chain.from_iterable(found), dtype="<u4").tobytes()
        ends = list(accumulate(map(len, found), initial=0))
        return [line[4 * a:4 * b] for a, b in pairwise(ends)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks behind a space. Chunks that hold no space and start and
        end with printable characters are encoded many at a time, as one text:
        it is cut before every space, and only there an id starts with one."""
        np = self.np
        plain = [c for c in chunks if PLAIN.fullmatch(c)]
        parts = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        found: dict[str, bytes] = {}
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["".join([" " + c for c in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cuts = [*(np.flatnonzero(self.spaced[ids]) * 4).tolist(), 4 * len(ids)]
            line = ids.tobytes()
            found.update(zip(part, [line[a:b] for a, b in pairwise(cuts)], strict=True))
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, self._encode([" " + c for c in rest]), strict=True))
        return [found[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [[t] if any(s in t for s in self.special) else split_text(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        need: set[str] = set()
        for chunks in split:
            need.update(chunks[1:])
        new = list(need.difference(cache))
        # all chunks but a text's first follow a space, which is theirs
        cache.update(zip(new, self._encode_chunks(new), strict=True))
        look = cache.__getitem__
        firsts = self._encode([chunks[0] for chunks in split])
        out = [first + b"".join(map(look, chunks[1:])) for first, chunks in zip(firsts, split, strict=True)]
        for c in new:
            if len(c) > CACHE_CHARS:
                del cache[c]
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """The encoder of ``path``, made once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def binary_lengths(n: int, most: int) -> list[int]:
    """``n`` as blocks of ``most`` (a power of two) and then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS,
                   end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, bucket (binary logarithm of the length),
    sequence_id, offset (always 0: a piece is a whole sequence).

    Null texts count as empty: such a document is its end id alone. Repeated
    rows and null ids are packed like any other row; an empty table gives no
    rows; further columns are not read.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = chunk_encoder(tokenizer_path)
        names = [f.name for f in PIECES.fields]
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                            ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("bucket", pa.int32())])

        def cut(ids: list, texts: list[str]) -> pa.RecordBatch:
            out = {n: [] for n in names}
            for doc_id, data in zip(ids, encoder.encode(texts), strict=True):
                data += end
                n, start = len(data) // 4, 0
                for length in binary_lengths(n, max_tokens):
                    for name, value in zip(names, (doc_id, start, length, data[4 * start:4 * (start + length)],
                                                   n, length.bit_length() - 1), strict=True):
                        out[name].append(value)
                    start += length
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= BATCH_CHARS:
                    yield cut(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield cut(ids, texts)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (slim.mapInArrow(pieces, PIECES)
            .withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def packed_rows(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset", "bucket")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_rows(docs)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"))
