import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wirefold.llm.packing import SPLIT, ChunkEncoder, binary_lengths, pack_documents, split_text

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


TRICKY = ["", " ", "a  b", " lead", "tail ", "it's we'll  x", "a\tb c\nd e", "é ñ ü ß Ö", "x \n y", "日本 語 text",
          "a b c d", "\x1c a \x85 b", "<|endoftext|> <|endoftext|>", " <|endoftext|>", "a b <|endoftext|> c d", "a<|endoftext|>b", "1 234 5.6 -7", "''s 's", "! ? .", "a\x00 b"]


def test_chunks_give_the_ids_of_the_whole_text(reference):
    encoder = ChunkEncoder(PATH)
    for text in TRICKY + [" ".join(TRICKY)]:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference(text), repr(text)


def test_split_is_the_pattern():
    for text in TRICKY + [" ".join(TRICKY), "plain words.\nAnd é more", "a \n", "\na b"]:
        assert split_text(text) == SPLIT.split(text)


def test_lengths():
    for n in range(1, 5000, 7):
        cut = binary_lengths(n, 256)
        assert sum(cut) == n and all(x & (x - 1) == 0 and x <= 256 for x in cut) and cut == sorted(cut, reverse=True)
        assert len([x for x in cut if x < 256]) == len({x for x in cut if x < 256})


def test_round_trip(docs_frame, edge_rows, reference):
    rows = edge_rows + [(100 + i, t, None) for i, t in enumerate(TRICKY)]
    out = pack_documents(docs_frame(rows), PATH).collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    back = {}
    for r in out:
        assert r["length"] <= 2048 and r["length"] == 1 << r["bucket"] and r["offset"] == 0
        back.setdefault(r["doc_id"], {}).setdefault(r["start"], []).append(bytes(r["ids"]))
    for i, text, _ in rows:
        if i in (1, None):
            continue
        data = b"".join(back[i][s][0] for s in sorted(back[i]))
        assert np.frombuffer(data, "<u4").tolist() == [*reference(text or ""), 1]
    assert len(back[1][0]) == 2 and zlib.crc32(back[1][0][0]) == zlib.crc32(back[1][0][1])


def test_empty_table(docs_frame):
    assert pack_documents(docs_frame([]), PATH).count() == 0


def test_chunks_outlast_a_million_others(monkeypatch):
    encoder, encoded = ChunkEncoder(PATH), []
    monkeypatch.setattr(encoder, "_encode_chunks", lambda chunks: encoded.extend(c for c in chunks if c == "often") or [b""] * len(chunks))
    monkeypatch.setattr(encoder, "_encode", lambda chunks: [b""] * len(chunks))
    for part in ["x often " + " ".join(f"{i}" for i in range(k, k + 250_000)) for k in range(0, 1_000_000, 250_000)]:
        encoder.encode([part])
    assert encoded == ["often"]
