"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus
signs, digits, schemes and identifier cues. From each anchor a local parser
expands to the boundaries of the item and checks it: e-mail addresses from the
at-sign, IPv4 addresses, cards and phones from their digits or plus sign, web
addresses with user data from the scheme, account numbers (IBAN by its mod-97
check, other identifiers by their cue) from the cue. Every parser is linear in
the text: a run of digits or name characters is entered once. One narrow pass,
no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")

# Anchors.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "passport", "ssn", "password", "token", "api_key", "api key", "user id", "userid")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
AUTHORITY = re.compile(r"[^\s/?#\"'<>]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
CUE_VALUE = re.compile(r"""[ \t]{0,3}(?:[:=#]|is)?[ \t]{0,3}["']?([A-Za-z0-9][A-Za-z0-9_-]{5,}+)""")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    if not 15 <= len(value) <= 34:
        return False
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_end(text: str, start: int) -> int:
    """End of the longest valid IBAN at ``start`` that ends before a character
    that is no capital or digit, or else at a blank; 0 if there is none."""
    m = IBAN.match(text, start)
    end = m.end() if m else start
    while end - start >= 15:
        after = text[end:end + 1]
        if not (after.isascii() and (after.isdigit() or after.isupper())) and iban_ok(text[start:end]):
            return end
        end -= 1
        while end > start and text[end - 1] == " ":
            end -= 1
    return 0


def build_automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("@", "+", *"0123456789"):
        found.add_word(word, (word if word in "@+" else "digit", 1))
    for word in SCHEMES:
        found.add_word(word, ("scheme", len(word)))
    for word in CUES:
        found.add_word(word, ("cue", len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """Lower case of the same length, so that positions stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low


def find_spans(text: str, automaton) -> dict[str, list[tuple[int, int]]]:
    """(start, end) by kind, in order, in code points, ends exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end_of = dict.fromkeys(KINDS, 0)  # no new match of a kind starts before this
    digits_end = 0  # end of the digit run entered last
    authority_end = last_sign = 0  # of the authority read last: its end, its last at-sign before the final character
    refused = 0, 0  # the value read last after a cue that has too few digits
    for at, (anchor, length) in automaton.iter(lowered(text)):
        start = at - length + 1
        if anchor == "digit":
            if start < digits_end:
                continue
            digits_end = DIGITS.match(text, start).end()
            if start >= end_of["ip"] and (m := IP.match(text, start)):
                end_of["ip"] = m.end()
                # a leading zero or a long part is read as its number
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                    out["ip"].append(m.span())
            if start >= end_of["card"] and (m := CARD.match(text, start)):
                end_of["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif anchor == "@":
            floor, left = end_of["email"], start
            while left > floor and text[left - 1] in LOCAL_CHARS:
                left -= 1
            if left < start and (m := DOMAIN.match(text, start + 1)):
                end_of["email"] = m.end()
                out["email"].append((left, m.end()))
        elif anchor == "+":
            if start >= end_of["phone"] and (m := PHONE.match(text, start)):
                end_of["phone"] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif anchor == "scheme":
            # a scheme inside an authority ends where that one does: each is read once
            if at + 1 >= authority_end and (m := AUTHORITY.match(text, at + 1)):
                authority_end = m.end()
                last_sign = text.rfind("@", at + 2, authority_end - 1)
            # a web address is personal when it carries user data before an at-sign
            if start >= end_of["address"] and at + 1 < authority_end and last_sign > at + 1:
                end_of["address"] = authority_end
                out["address"].append((start, authority_end))
        else:
            before = text[start - 1:start]
            if start < end_of["account"] or before.isalnum() or before == "_":
                continue
            if refused[0] <= at + 1 and at + 3 < refused[1]:
                continue  # its value would be the end of one with too few digits
            if text[start:at + 1].lower() == "iban":
                skip = re.compile(r"[\s:=#]{0,4}").match(text, at + 1).end()
                if end := iban_end(text, skip):
                    end_of["account"] = end
                    out["account"].append((skip, end))
            elif m := CUE_VALUE.match(text, at + 1):
                if sum(c.isdigit() for c in m.group(1)) >= 4:
                    end_of["account"] = m.end(1)
                    out["account"].append(m.span(1))
                else:
                    refused = m.span(1)
    return out


SPANS = T.StructType([T.StructField("doc_id", T.LongType())]
                     + [T.StructField(f"n_{k}", T.LongType(), False) for k in KINDS]
                     + [T.StructField("base_spans", T.StringType(), False), T.StructField("spans", T.StringType(), False)])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> for each kind, base_spans
    and spans as ``kind:start:end`` joined by commas, by kind and then start.

    Null texts count as empty: counts of zero and empty strings. Null ids and
    repeated rows come out as they are; an empty table gives no rows; further
    columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        schema = pa.schema([(f.name, pa.string() if f.name.endswith("spans") else pa.int64()) for f in SPANS.fields])
        for batch in batches:
            rows = {f.name: [] for f in SPANS.fields}
            rows["doc_id"] = batch.column(0)
            for text in batch.column(1):
                found = find_spans(text.as_py(), automaton)
                for k in KINDS:
                    rows[f"n_{k}"].append(len(found[k]))
                said = {k: [f"{k}:{a}:{b}" for a, b in found[k]] for k in KINDS}
                rows["base_spans"].append(",".join(x for k in BASE_KINDS for x in said[k]))
                rows["spans"].append(",".join(x for k in KINDS for x in said[k]))
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, SPANS)


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE_KINDS],
                        F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_address", "n_account")
