"""Exact SentencePiece encoding (merge type) by backtracking, and decoding.

A merge-type model joins, as long as it can, the adjacent pair whose joined
piece has the highest score, the leftmost of equals. No merge of the result
ever crosses a boundary between two of its pieces, and what happens on both
sides of a boundary depends on the two adjacent pieces alone; so a sequence of
pieces is the model's encoding if, and only if, each two neighbours re-merge
to themselves. The encoder therefore searches such a sequence from the left:

* Aho-Corasick over the reversed pieces finds the longest piece that starts at
  each position, in one pass;
* a piece is taken if it and its left neighbour re-merge to themselves (the
  answers are kept, as few pairs are common), otherwise the next shorter one;
* where none is left, the position is marked in a bitfield of failed positions
  and the piece before it is shortened. The encoding of a prefix is unique, so
  a failed position never needs a second look, and the time is linear.

Characters without a piece are symbols of their own and become byte pieces.
Texts are cut where no merge can cross, since no piece of the vocabulary holds
those two characters in a row: around characters that stand in no longer
piece, between a letter and what never follows one, and before a run of space
symbols. Each distinct chunk is encoded once and remembered in a bounded cache
that lives as long as its Python worker. The vocabulary file is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm.common import table

SPACE = "▁"
#: Fixed kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Remembered chunks and pairs of a worker, and the longest chunk that is remembered.
CACHE_CHUNKS, CACHE_PAIRS, CACHE_CHARS = 600_000, 400_000, 48
#: Characters of text that are handled between two outputs.
BATCH_CHARS = 2_000_000

#: Below every score.
END = float("-inf")


def chunk_pattern(pieces: Iterable[str]) -> re.Pattern | None:
    """Cuts a text into chunks that no merge of these pieces can cross; None if
    a piece holds a space symbol behind another character."""
    pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
    if any(b == SPACE != a for a, b in pairs):
        return None
    joining = {c for pair in pairs for c in pair} - {SPACE}
    letters = {c for c in joining if c.isalpha()}
    follow = {b for a, b in pairs if a in letters} - letters
    any_of = lambda chars: "".join(map(re.escape, sorted(chars)))
    alone = f"[^{SPACE}{any_of(joining)}]"
    word = f"{SPACE}*[{any_of(letters)}]++" + (f"(?![{any_of(follow)}])" if follow else "") if letters else alone
    rest = f"{SPACE}+[{any_of(joining)}]*|[{any_of(joining)}]+" if joining else f"{SPACE}+"
    return re.compile(f"{alone}|{word}|{rest}", re.DOTALL)


class PieceModel:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trainer, rules = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if (trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix or rules.precompiled_charsmap
                or rules.remove_extra_whitespaces or not rules.escape_whitespaces or kinds & {USER, UNUSED}):
            raise ValueError("only merge-type models without normalisation, user-defined and unused pieces are covered")
        self.dummy_prefix = rules.add_dummy_prefix
        self.byte_fallback = trainer.byte_fallback
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        surface = {NORMAL: lambda p: p.piece.replace(SPACE, " ").encode(), CONTROL: lambda p: b"",
                   UNKNOWN: lambda p: trainer.unk_surface.encode(), BYTE: lambda p: bytes([int(p.piece[1:-1], 16)])}
        self.surface = [surface[p.type](p) for p in model.pieces]
        self.is_byte = [p.type == BYTE for p in model.pieces]
        self.silent = {i for i, data in enumerate(self.surface) if not data}
        self.spaced = [p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces]
        self.pattern = chunk_pattern(self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece[::-1], len(piece))
        self.automaton.make_automaton()
        self.shorter_of: dict[str, str | None] = {}
        self.steps_of: dict[str, list[tuple[float, str, str]] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """A short text merged as the model defines it: the pieces, and for each
        merge its score and the first and last symbol before it."""
        symbols, scores = list(text), self.scores
        joined = [scores.get(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
        steps = []
        while True:
            best, at = None, -1
            for i, score in enumerate(joined):
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return symbols, steps
            steps.append((best, symbols[0], symbols[-1]))
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = scores.get(symbols[at - 1] + symbols[at])
            if at + 1 < len(symbols):
                joined[at] = scores.get(symbols[at] + symbols[at + 1])

    def steps(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that build ``piece``, and its end state; None if it is
        not what its own characters merge to."""
        if piece not in self.steps_of:
            pieces, steps = self.merge(piece)
            self.steps_of[piece] = [*steps, (END, piece, piece)] if pieces == [piece] else None
        return self.steps_of[piece]

    def fits(self, left: str, right: str) -> bool:
        """True if the two pieces (or the right one alone) re-merge to themselves:
        the merges of both are replayed by score, and at no time may the pair
        across the boundary be the one to merge next."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._fits(left, right)
        return found

    def _fits(self, left: str, right: str) -> bool:
        after = self.steps(right)
        if after is None or not left:
            return after is not None
        before, scores = self.steps(left), self.scores
        i = j = 0
        while True:
            on_left, _, last = before[i]
            on_right, first, _ = after[j]
            across = scores.get(last + first)
            if across is not None and across > on_left and across >= on_right:
                return False
            if on_left >= on_right:
                if on_left == END:
                    return True
                i += 1
            else:
                j += 1

    def shorter(self, piece: str) -> str | None:
        """The longest piece or single character that properly starts ``piece``."""
        found = self.shorter_of.get(piece, piece)
        if found is piece:
            n = next((n for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.ids), 1)
            found = self.shorter_of[piece] = piece[:n] if len(piece) > 1 else None
        return found

    def longest(self, text: str) -> list[int]:
        """For each position, the length of the longest piece that starts there (1 if none does)."""
        found = [1] * len(text)
        for end, length in self.automaton.iter(text[::-1]):
            if length > found[~end]:
                found[~end] = length
        return found

    def pieces(self, text: str) -> list[str]:
        """The pieces of one chunk, by backtracking."""
        n, longest = len(text), self.longest(text)
        failed, any_failed = bytearray(n // 8 + 1), False
        known, fits = self.pairs.get, self.fits
        taken: list[str] = []
        at, left, piece = 0, "", text[:longest[0]] if n else None
        while piece is not None:
            end = at + len(piece)
            if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                fit = known((left, piece))
                if fit or fit is None and fits(left, piece):
                    taken.append(piece)
                    if end == n:
                        break
                    at, left, piece = end, piece, text[end:end + longest[end]]
                    continue
            piece = self.shorter(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = taken.pop()
                at -= len(piece)
                left = taken[-1] if taken else ""
        return taken

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        found = self.chunks.get(chunk)
        if found is None:
            ids: list[int] = []
            for piece in self.pieces(chunk):
                if (known := self.ids.get(piece)) is not None:
                    ids.append(known)
                elif self.byte_fallback:
                    ids.extend(self.bytes[b] for b in piece.encode())
                else:
                    ids.append(self.unknown)
            found = tuple(ids)
            if len(chunk) <= CACHE_CHARS:
                if len(self.chunks) >= CACHE_CHUNKS:
                    self.chunks.clear()
                self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        chunks = self.pattern.findall(text) if self.pattern else [text]
        ids = list(chain.from_iterable(map(self.chunk_ids, chunks)))
        if not self.byte_fallback:  # a run of unknown characters is one unknown piece
            ids = [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != i]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The first space symbol is the dummy prefix; bytes
        that are no valid UTF-8 become one replacement character each."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix:
            for i in ids:  # pieces without a surface before the first one don't count
                if self.surface[i]:
                    if self.spaced[i]:
                        data = data[1:]
                    break
        if self.silent.isdisjoint(ids):  # otherwise a control piece may stand between two bytes of a character
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        out = []
        for is_byte, run in groupby(ids, self.is_byte.__getitem__):
            part = b"".join(map(self.surface.__getitem__, run))
            out.append(_lenient(part) if is_byte else part.decode())
        text = "".join(out)
        return text[1:] if self.dummy_prefix and self._starts_spaced(ids) else text

    def _starts_spaced(self, ids: list[int]) -> bool:
        first = next((i for i in ids if self.surface[i]), None)
        return first is not None and self.spaced[first]


def _lenient(data: bytes) -> str:
    out = []
    while data:
        for n in range(1, 5):
            try:
                out.append(data[:n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        data = data[n:]
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of ``path``, read once per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _per_row(out: list[tuple[str, pa.DataType]], make: Callable[[object], tuple], size: Callable[[object], int]):
    """Arrow pass over (id, value) rows: the id and what ``make`` gives for the
    value; rows are put out whenever their values reach ``BATCH_CHARS``."""
    schema = pa.schema([("doc_id", pa.int64()), *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made, seen = [], [], 0
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = value.as_py()
                ids.append(i)
                made.append(make(value))
                seen += size(value)
                if seen >= BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, zip(*made, strict=True), schema.types[1:])], schema=schema)
                    ids, made, seen = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, zip(*made, strict=True), schema.types[1:])], schema=schema)

    return run


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts; with ``decoded`` also the text
    that the ids decode to. One narrow pass.

    Null texts count as empty, and an empty text has no ids. Repeated rows and
    null ids are encoded like any other row; an empty table gives no rows;
    further columns, whatever their names, aren't read. Texts of any length
    are encoded whole.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make(text: str) -> tuple:
        model = piece_model(model_path)
        ids = model.encode(text)
        return (ids, model.decode(ids)) if decoded else (ids,)

    out = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())][:2 if decoded else 1]
    return slim.mapInArrow(_per_row(out, make, len), "doc_id long, ids array<int>" + (", decoded string" if decoded else ""))


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids count as none."""
    slim = encoded.select(F.col(id_col).cast("long").alias("doc_id"),
                          F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return slim.mapInArrow(_per_row([("text", pa.string())], lambda ids: (piece_model(model_path).decode(ids),), len),
                           "doc_id long, text string")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
