import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from wirefold.llm.sentencepieces import PieceModel, decode_documents, encode_documents, op12_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["", " ", "  ", "a", "a  b", " lead", "tail ", "\n\n x\t", "é ñ ü 日本語 テキスト 𝔘𝔫𝔦 🙂🙃", "<s> </s> <unk> <0x41>",
          "▁x ▁▁ y", "a\x00b", "�", "x" * 3000, "ab" * 5000, " " * 1000, "aaaa " * 500, "1234567890", "İstanbul ÇĞŞ",
          "\r\n\r\n", " 　x", "http://a.b/c?d=e&f=g", "don't stop-me now... (really?)"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


def test_ids_and_texts_of_the_library(model, library):
    rnd = random.Random(5)
    letters, pieces = "abcdefghijklmnopqrstuvwxyz  ,.'-\n éß日🙂▁", sorted(model.ids)
    texts = TRICKY + ["".join(rnd.choices(letters, k=rnd.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(rnd.choices(pieces, k=rnd.randint(1, 12))) for _ in range(2500)]
    texts += ["".join(rnd.choices("ab ", k=rnd.randint(1, 60))) for _ in range(500)]
    for text in texts:
        ids = library.encode(text)
        assert model.encode(text) == ids, repr(text)
        assert model.decode(ids) == library.decode(ids), repr(text)


def test_cuts_change_nothing(model):
    whole = PieceModel(PATH)
    whole.pattern = None
    rnd = random.Random(6)
    for _ in range(300):
        text = " ".join("".join(rnd.choices("etaoin shrdlu.,'-1\n", k=rnd.randint(1, 30))) for _ in range(3))
        assert whole.encode(text) == model.encode(text)


def test_any_ids_decode_like_the_library(model, library):
    rnd = random.Random(7)
    for _ in range(5000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(260), rnd.randrange(3), 29871]) for _ in range(rnd.randint(1, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_backtracking_leaves_greedy_choices(model, library):
    """Some texts are not split into longest matches; the search must turn back there."""
    turned = 0
    for text in sorted(model.ids)[::7]:
        text = text + "ing" + text
        greedy, at = [], 0
        longest = model.longest(text)
        while at < len(text):
            greedy.append(text[at:at + longest[at]])
            at += longest[at]
        found = model.pieces(text)
        assert found == model.merge(text)[0]
        turned += found != greedy
    assert turned > 20


def test_rows(spark, docs_frame, edge_rows, library):
    rows = edge_rows + [(100 + i, t, None) for i, t in enumerate(TRICKY)]
    out = encode_documents(docs_frame(rows).withColumn("ids", F.lit("clash")), PATH, decoded=True).collect()
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted(map(repr, ((r["doc_id"], r["ids"], r["decoded"]) for r in out))) == sorted(map(repr, want))
    back = decode_documents(encode_documents(docs_frame(rows), PATH), PATH).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in back))) == sorted(repr((i, t)) for i, _, t in want)
    assert encode_documents(docs_frame([]), PATH).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode_documents(none, PATH).first()["text"] == ""


def test_query(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12_pieces(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
