"""Scalar text rules on the FIXTURES.md rows."""
import re

from pyspark.sql import functions as F

from wirefold.functions import markup as M
from wirefold.functions import text as T


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def py_normalize(t):
    if not t:
        return ""
    t = t.lower()
    t = re.sub(r"[^\w\s]", " ", t)
    return re.sub(r"\s+", " ", t).strip()


def test_normalize_fixture_rows(spark):
    rows = [(None, ""), ("", ""), ("İstanbul'da SON dakika!", "i stanbul da son dakika"),
            ("100% 3.5", "100 3 5"), ("KÖŞE YAZISI  _x_ ²³", "köşe yazisi _x_ ²³"),
            ("café x", "cafe x")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    got = [r["n"] for r in df.select(T.normalize("t").alias("n")).collect()]
    assert got == [b for _, b in rows]


def test_normalize_matches_python_on_unicode(spark):
    samples = ["a\x1cb c\xa0d\x0be", "Ελληνικά Σ. नमस्ते ₂", "x_y-z", "tab\tand\nnew", "ß straße ǅ",
               "emoji 📰 ok", "١٢٣ arabic digits", "mixed​zero"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r["n"] for r in df.select(T.normalize("t").alias("n")).collect()]
    assert got == [py_normalize(s) for s in samples]


def test_clean_text(spark):
    assert _one(spark, T.clean_text(F.lit(" a \n\t b "))) == "a b"
    assert _one(spark, T.clean_text(F.lit("<b>x</b>"))) == "<b>x</b>"
    assert _one(spark, T.clean_text(F.lit("a" * 2001))) == "a" * 2000


def test_column_flag(spark):
    assert _one(spark, T.keyword_flag(F.lit("http://x/yazarlar/1"), F.lit("")))
    assert _one(spark, T.keyword_flag(F.lit("u"), F.lit("Köşe")))
    assert _one(spark, T.keyword_flag(F.lit("u"), F.lit("YAZI")))
    assert not _one(spark, T.keyword_flag(F.lit("http://x/haber"), F.lit("Son dakika")))


def test_resolve_link(spark):
    page = F.lit("https://a.b/c?x=1")
    assert _one(spark, T.resolve_link(F.lit("/d"), page)) == "https://a.b/d"
    assert _one(spark, T.resolve_link(F.lit("//cdn/x"), page)) == "https://a.b//cdn/x"
    assert _one(spark, T.resolve_link(F.lit("http://q/"), page)) == "http://q/"
    assert _one(spark, T.resolve_link(F.lit("d/e"), page)) == "d/e"


def test_anchor_text(spark):
    assert _one(spark, M.node_text_joined(F.lit("Bu <b>uzun</b> satır"))) == "Buuzunsatır"


def test_render(spark):
    msg = _one(spark, T.render_message(F.lit("a<b & c"), F.lit(""), F.lit("body"), F.lit("src"),
                                       F.lit("http://u"), F.lit(True)))
    assert msg.startswith("📰 <b>a&lt;b & c</b>" + T.COLUMN_TAG + "\n\nbody\n\n")
    assert msg.endswith("📌 <i>src</i>\n🔗 http://u")


def test_chunks(spark):
    assert len(_one(spark, T.chunk_pieces(F.lit("a" * 3800)))) == 1
    p = _one(spark, T.chunk_pieces(F.lit("a" * 3801)))
    assert [len(x) for x in p] == [3800, 1]
    assert _one(spark, T.chunk_pieces(F.lit(""))) == []


def test_parse_slot(spark):
    assert _one(spark, T.parse_slot(F.lit("09:05"))).asDict() == {"hour": 9, "minute": 5}
    assert _one(spark, T.parse_slot(F.lit("9:5"))).asDict() == {"hour": 9, "minute": 5}
    assert _one(spark, T.parse_slot(F.lit("24:00"))).asDict() == {"hour": 24, "minute": 0}
    assert _one(spark, T.parse_slot(F.lit("1:2:3"))) is None
    assert _one(spark, T.parse_slot(F.lit("a:b"))) is None


def test_entities(spark):
    assert _one(spark, T.decode_entities(F.lit("a&#233;b&#x41;&amp;lt;&copy;"))) == "aébA&lt;©"
