"""Scalar text functions as Spark Columns (all JVM-side, codegen friendly).

Every function takes and returns ``Column``; NULL and empty text act alike,
as in the behaviour being matched.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the behaviour being matched.
# ---------------------------------------------------------------------------
# Opinion-column keywords, substring match on lower(url + " " + title).
COLUMN_KEYWORDS = [
    "köşe", "yazar", "yazısı", "yorum", "kose", "yazi",
    "/yazarlar/", "/kose/", "/yorum/", "columnist",
]
# Host put in front of a post path that starts with "/".
POST_HOST = "https://twitter.com"
# Mirrors of a timeline that are tried, by rank.
MIRRORS = 4
CLEAN_MAX_CHARS = 2000       # text cut after whitespace collapse
TITLE_MAX_CHARS = 100        # post title taken from content
TITLE_ELLIPSIS = "…"         # added when the content was longer
CHUNK_CHARS = 3800           # report message piece size
MIN_LINK_TITLE = 15          # anchor text shorter than this is dropped
COLUMN_TAG = " 📝<i>köşe yazısı</i>"
STATUS_ON = "✅"
STATUS_OFF = "❌"

# Whitespace as Python's str.isspace() sees it, written so that both the
# Java regex engine (Spark) and RE2 (the DuckDB oracle) read it the same way.
WS_CLASS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
# Everything that is neither a word character (letter, number, underscore,
# as Python's Unicode \w) nor whitespace.
NON_WORD = r"[^\p{L}\p{N}_" + WS_CLASS + r"]"
WS_RUN = r"[" + WS_CLASS + r"]+"
WS_EDGES = r"^[" + WS_CLASS + r"]+|[" + WS_CLASS + r"]+$"

# What may follow "&" in a character reference, and the names that HTML knows
# (those that end in ";"), from the standard library.
ENTITY_RX = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMED_ENTITIES = {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_empty(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def ws_trim(c) -> Column:
    """Strip Unicode whitespace at both ends (Python ``str.strip()``)."""
    return F.regexp_replace(_c(c), WS_EDGES, "")


def normalize(c) -> Column:
    """NULL/'' -> ''; lower-case; non-word chars -> space; collapse; trim."""
    t = F.lower(blank_to_empty(c))
    t = F.regexp_replace(t, NON_WORD, " ")
    t = F.regexp_replace(t, WS_RUN, " ")
    return F.trim(t)


def corpus_text(title, content) -> Column:
    """Title and content joined by one space, NULL as '', then normalised."""
    return normalize(F.concat(blank_to_empty(title), F.lit(" "), blank_to_empty(content)))


def clean_text(c, max_chars: int = CLEAN_MAX_CHARS) -> Column:
    """Collapse whitespace, trim, cut to ``max_chars`` code points."""
    t = F.regexp_replace(blank_to_empty(c), WS_RUN, " ")
    return F.substring(F.trim(t), 1, max_chars)


def keyword_flag(url, title, keywords=COLUMN_KEYWORDS) -> Column:
    """True when any keyword is a substring of lower(url + ' ' + title)."""
    text = F.lower(F.concat(blank_to_empty(url), F.lit(" "), blank_to_empty(title)))
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | F.instr(text, kw).__gt__(0)
    return cond


def url_base(page_url) -> Column:
    """``scheme://host`` of a URL, '' when it does not start with http(s)://."""
    return F.regexp_extract(blank_to_empty(page_url), r"^(https?://[^/]+)", 1)


def resolve_link(href, page_url) -> Column:
    """An href starting with '/' gets the page's ``scheme://host`` (also for
    '//host/x'); anything else is returned unchanged."""
    base = url_base(page_url)
    h = _c(href)
    return F.when(h.startswith("/") & (base != ""), F.concat(base, h)).otherwise(h)


def truncate_title(c, n: int = TITLE_MAX_CHARS) -> Column:
    t = blank_to_empty(c)
    return F.concat(F.substring(t, 1, n),
                    F.when(F.length(t) > n, F.lit(TITLE_ELLIPSIS)).otherwise(F.lit("")))


def rewrite_path(path, host: str = POST_HOST) -> Column:
    p = blank_to_empty(path)
    return F.when(p.startswith("/"), F.concat(F.lit(host), p)).otherwise(p)


def strip_handle(c) -> Column:
    return F.regexp_replace(_c(c), r"^@+", "")


def first_nonempty(*cols) -> Column:
    """First argument that is neither NULL nor ''; '' if none is."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols], F.lit(""))


def escape_angle(c) -> Column:
    """Escape '<' and '>' only ('&' is left as it is); NULL -> ''."""
    return F.replace(F.replace(blank_to_empty(c), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def render_message(title, summary, content, source_name, url, is_column) -> Column:
    """Delivery message text in the fixed template."""
    body = escape_angle(first_nonempty(summary, content))
    tag = F.when(F.coalesce(_c(is_column), F.lit(False)), F.lit(COLUMN_TAG)).otherwise(F.lit(""))
    return F.concat(
        F.lit("📰 <b>"), escape_angle(title), F.lit("</b>"), tag,
        F.lit("\n\n"), body,
        F.lit("\n\n📌 <i>"), escape_angle(source_name), F.lit("</i>\n🔗 "),
        blank_to_empty(url),
    )


def chunk_pieces(c, n: int = CHUNK_CHARS) -> Column:
    """Array of consecutive pieces of ``n`` code points; empty text -> []."""
    t = blank_to_empty(c)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / n).cast("int")),
                    lambda i: F.substring(t, i * n + 1, n)))


def source_line(source_id, source_type, name, active, url, handle) -> Column:
    """One report line per source: status mark, id, type, name, target."""
    status = F.when(_c(active), F.lit(STATUS_ON)).otherwise(F.lit(STATUS_OFF))
    target = F.coalesce(F.nullif(_c(url), F.lit("")),
                        F.concat(F.lit("@"), blank_to_empty(handle)))
    return F.concat(status, F.lit(" <code>"), _c(source_id).cast("string"), F.lit("</code> ["),
                    _c(source_type), F.lit("] <b>"), _c(name), F.lit("</b> — "), target)


def format_slot(hour, minute) -> Column:
    return F.format_string("%02d:%02d", _c(hour), _c(minute))


def parse_slot(text) -> Column:
    """``H:M`` -> struct(hour, minute); NULL unless exactly two integer parts.
    The range check is a separate constraint (see ``state.validate``)."""
    parts = F.split(blank_to_empty(text), ":")
    hc = F.trim(F.element_at(parts, 1)).try_cast("int")
    mc = F.trim(F.element_at(parts, 2)).try_cast("int")
    ok = (F.size(parts) == 2) & hc.isNotNull() & mc.isNotNull()
    return F.when(ok, F.struct(hc.alias("hour"), mc.alias("minute")))


def _reference(piece: Column, names: Column) -> Column:
    """A piece of text that followed an "&", with its reference decoded."""
    name = F.regexp_extract(piece, ENTITY_RX, 1)
    digits = F.substring(name, 2, 8)
    code = (F.when(name.startswith("#x") | name.startswith("#X"), F.conv(F.substring(name, 3, 6), 16, 10).cast("long"))
            .when(name.startswith("#"), digits.try_cast("long")))
    valid = (code > 0) & (code <= 0x10FFFF) & ~((code >= 0xD800) & (code <= 0xDFFF))
    known = (F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
             .when(name == "amp", F.lit("&")).when((name != "") & ~name.startswith("#"), F.element_at(names, name)))
    rest = F.regexp_replace(piece, ENTITY_RX, "")
    return F.when((name != "") & known.isNotNull(), F.concat(known, rest)).otherwise(F.concat(F.lit("&"), piece))


def decode_entities(c) -> Column:
    """Decode numeric and named character references, each once, left to
    right: "&#38;lt;" gives "&lt;". Unknown names stay as they are."""
    t = blank_to_empty(c)
    parts = F.split(t, "&")
    names = F.from_json(F.lit(json.dumps(NAMED_ENTITIES)), "map<string,string>")  # folded to a constant
    tail = F.transform(F.slice(parts, 2, 1 << 30), lambda p: _reference(p, names))
    return F.when(F.size(parts) <= 1, t).otherwise(F.concat(F.element_at(parts, 1), F.array_join(tail, "")))


def tokens(normalized) -> Column:
    """Runs of two or more word characters; after ``normalize`` that is
    'split on the single space, keep length >= 2'."""
    return F.filter(F.split(_c(normalized), " "), lambda x: F.length(x) >= 2)


def ngram_terms(toks) -> Column:
    """Unigrams then bigrams (bigrams joined by one space), built from the
    token list after one-character tokens were dropped."""
    t = _c(toks)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.concat(t, F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))
