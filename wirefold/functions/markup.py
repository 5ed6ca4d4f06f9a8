"""Markup scanning in one pass, as Spark Columns.

Every pattern here consumes what it has read: a tag, comment, script or style
that is never closed runs to the end of the page (as the HTML standard's
tokenizer has it), so no character is read from two starts and the time is
linear in the page, whatever it holds. Repeated groups are possessive, which
Java runs as a loop and not by recursion, so no page needs a deep stack.

A tag starts with ``<`` and a letter, ``/``, ``!`` or ``?``; quotes count as
such only behind ``=``, and a quote that is never closed doesn't quote.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirefold.functions.text import blank_to_empty, decode_entities, ws_trim

#: Put before and behind a mark that is to be found again (no characters of HTML).
OPEN, CLOSE = "\x01", "\x02"


def attributes_rx(own: str = "+") -> str:
    """The rest of a tag up to ``>`` or the end. ``own`` is the possessive sign;
    it is empty for engines without it, which give the same matches."""
    return rf"""[^>=]*{own}(?:=\s*{own}(?:"[^"]*{own}"|'[^']*{own}')?{own}[^>=]*{own})*{own}"""


def markup_rx(own: str = "+") -> str:
    """One unit of markup: a comment, a script or style element whole, or a tag."""
    rest = attributes_rx(own)
    raw = "|".join(rf"{name}(?:[\s/]{rest})?{own}(?:\z|>.*?(?:</{name}(?:[\s/][^>]*{own})?{own}(?:>|\z)|\z))"
                   for name in ("script", "style"))
    return rf"<(?:!--(?:-?>|.*?(?:--!?>|\z))|{raw}|[a-z/!?]{rest}(?:>|\z))"


def anchor_rx(own: str = "+") -> str:
    """A closed start tag or an end tag of an anchor."""
    return rf"<a(?:[\s/]{attributes_rx(own)})?{own}>|</a(?:[\s/][^>]*{own})?{own}>"


MARKUP = "(?is)" + markup_rx()
MARKED_ANCHORS = f"(?is)({anchor_rx()})|({markup_rx()})"
MARKED = f"(?is)({markup_rx()})"
ATTRIBUTE = r"""(?is)[\s"']([^\s=>"'/]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""


def html_to_text(markup) -> Column:
    """Text of an HTML fragment: each unit of markup becomes a space, then
    references are decoded."""
    return decode_entities(F.regexp_replace(blank_to_empty(markup), MARKUP, " "))


def node_text_joined(inner_html) -> Column:
    """Text nodes decoded and stripped, empty ones dropped, joined with no separator."""
    pieces = F.split(blank_to_empty(inner_html), MARKUP)
    stripped = F.transform(pieces, lambda p: ws_trim(decode_entities(p)))
    return F.array_join(F.filter(stripped, lambda p: p != ""), "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag, NULL if there is none. Quoted
    values are consumed whole, so names inside them and names that only end
    alike (``data-href``) don't count."""
    names = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1)
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2)
    found = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.lower(x["n"]) == name)
    value = F.get(found, F.lit(0))["v"]
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def has_class(tag: Column, token: str) -> Column:
    """True if ``token`` is among the classes of a start tag."""
    classes = F.split(F.coalesce(attribute(tag, "class"), F.lit("")), r"\s+")
    return F.when(F.instr(tag, token) > 0, F.array_contains(classes, token)).otherwise(F.lit(False))


def _plain(markup) -> Column:
    return F.translate(blank_to_empty(markup), OPEN + CLOSE, "")


def marked_parts(markup) -> Column:
    """A page cut before every unit of markup: parts of the form
    ``unit CLOSE text``; what precedes the first unit is left out."""
    return F.slice(F.split(F.regexp_replace(_plain(markup), MARKED, f"{OPEN}$1{CLOSE}"), OPEN), 2, 1 << 30)


def anchor_parts(markup) -> Column:
    """The page's anchors in order, as parts ``start tag CLOSE inner markup``.
    An anchor ends at its end tag, at the next anchor's start or with the page."""
    marked = F.replace(F.regexp_replace(_plain(markup), MARKED_ANCHORS, f"{OPEN}$1{CLOSE}$2"), F.lit(OPEN + CLOSE), F.lit(""))
    return F.filter(F.slice(F.split(marked, OPEN), 2, 1 << 30), lambda p: ~p.startswith("</"))


def part_tag(part: Column) -> Column:
    return F.substring_index(part, CLOSE, 1)


def part_rest(part: Column) -> Column:
    return F.substring(part, F.instr(part, CLOSE) + 1, F.lit(1 << 30))


def element_text(parts: Column, token: str) -> Column:
    """Text of the first element of class ``token`` in an array of parts, its
    markup as spaces, references decoded; NULL if there is none. It ends where
    as many elements of its name are closed as opened, or with the parts."""
    marks = F.transform(parts, lambda p: F.struct(
        F.lower(F.regexp_extract(part_tag(p), r"^</?([A-Za-z][^\s/>]*+)", 1)).alias("name"), p.startswith("</").alias("closes"),
        (~p.startswith("</") & has_class(part_tag(p), token)).alias("begins")))
    none = F.lit(None).cast("int")
    state = F.struct(F.lit(0).alias("at"), none.alias("first"), none.alias("last"), F.lit(0).alias("open"), F.lit("").alias("name"))

    def step(st, m):
        begins = st["first"].isNull() & m["begins"]
        opened = st["open"] + F.when(m["name"] != st["name"], 0).when(m["closes"], -1).otherwise(1)
        return F.struct((st["at"] + 1).alias("at"),
                        F.when(begins, st["at"]).otherwise(st["first"]).alias("first"),
                        F.when(st["first"].isNotNull() & st["last"].isNull() & (opened == 0), st["at"]).otherwise(st["last"]).alias("last"),
                        F.when(begins, F.lit(1)).otherwise(opened).alias("open"),
                        F.when(begins, m["name"]).otherwise(st["name"]).alias("name"))

    def inside(st):
        own = F.slice(parts, st["first"] + 1, F.coalesce(st["last"], F.size(parts)) - st["first"])
        return F.when(st["first"].isNotNull(), F.array_join(F.transform(own, part_rest), " "))

    # an array of one state, so that it is found once
    return decode_or_null(F.get(F.transform(F.array(F.aggregate(marks, state, step)), inside), F.lit(0)))


def decode_or_null(text: Column) -> Column:
    return F.when(text.isNotNull(), decode_entities(text))
