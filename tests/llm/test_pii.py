import re

from hypothesis import given, settings
from hypothesis import strategies as st

from wirefold.llm.pii import base_digest, build_automaton, find_personal_data, find_spans, luhn

AUTOMATON = build_automaton()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def ok(kind, s):
        digits = re.sub(r"[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
    return {k: [m.span() for m in re.finditer(p, text) if ok(k, m.group())] for k, p in PATTERNS.items()}


def base(text):
    return {k: v for k, v in find_spans(text, AUTOMATON).items() if k in PATTERNS}


CASES = ["", "a@b", "a@b.c@d.e", "x a.b+c@d-e.f.g. y", "1.2.3.4.5.6.7.8", "256.1.1.1", "1.2.3", "4111 1111-1111 1111",
         "4111111111111111", "+1 (988) 555-2485 or", "++12 345 678 90.", "+1+2345678901", "a@@b.c", "@b.c", "0001.0.0.255",
         "İstanbul i@x.y ß 4111111111111111", "1 2 3 4", "12-34--56", "@" * 50, "1" * 3000, "a" * 3000 + "@b.c", "4379 " * 9]


def test_base_spans_equal_the_patterns():
    for text in CASES + [" ".join(CASES), "".join(CASES)]:
        assert base(text) == brute(text), text[:80]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="01245.@+-() aZ%é", max_size=60))
def test_base_spans_equal_the_patterns_on_any_text(text):
    assert base(text) == brute(text)


def test_added_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, iban GB00WEST12345698765432 password=531ccd051a92ebcb68 https://me:pw@h.org/x http://h.org"
    found = find_spans(text, AUTOMATON)
    assert [text[a:b] for a, b in found["account"]] == ["GB82 WEST 1234 5698 7654 32", "531ccd051a92ebcb68"]
    assert [text[a:b] for a, b in found["address"]] == ["https://me:pw@h.org"]


def test_long_runs_are_linear():
    import time
    t = time.time()
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000):
        find_spans(text, AUTOMATON)
    assert time.time() - t < 20


def test_rows(docs_frame, edge_rows):
    rows = edge_rows + [(50, "mail me.at@x.example.com or 10.0.0.1", "en")]
    out = find_personal_data(docs_frame(rows)).collect()
    assert len(out) == len(rows)
    one = next(r for r in out if r["doc_id"] == 50)
    assert (one["n_email"], one["n_ip"], one["spans"]) == (1, 1, "email:5:24,ip:28:36")
    assert base_digest(one["base_spans"]) and find_personal_data(docs_frame([])).count() == 0


def test_accounts_reach_their_end():
    cases = [("IBAN: DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000"),
             ("IBAN DE89 3704 0044 0532 0130 00 BIC", "DE89 3704 0044 0532 0130 00"),
             ("iban: GB82 WEST 1234 5698 7654 32 AND MORE", "GB82 WEST 1234 5698 7654 32"),
             ("IBAN: GB82WEST12345698765432号", "GB82WEST12345698765432"), ("IBAN: GB82WEST12345698765432abc", "GB82WEST12345698765432"),
             ("api_key=" + "a1" * 100 + " end", "a1" * 100), ("token: " + "7" * 50_000, "7" * 50_000)]
    for text, want in cases:
        assert [text[a:b] for a, b in find_spans(text, AUTOMATON)["account"]] == [want], text[:60]
    assert find_spans("IBAN: DE89370400440532013001 BIC", AUTOMATON)["account"] == []


def test_schemes_and_cues_inside_a_run_are_read_once():
    import time
    t = time.time()
    assert find_spans("mailto:" * 150_000, AUTOMATON)["address"] == []
    assert find_spans("tokenx-" * 150_000, AUTOMATON)["account"] == []
    assert time.time() - t < 4
    mails = "mailto:" * 3 + "a@b.c mailto:x http://u@h mailto:@ mailto:@@ mailto:a@"
    assert [mails[a:b] for a, b in find_spans(mails, AUTOMATON)["address"]] == ["mailto:mailto:mailto:a@b.c", "http://u@h"]
    inner = "tokenx-tokenx-token: 12345678 tokenx-tokenis'abcd1234'"
    assert [inner[a:b] for a, b in find_spans(inner, AUTOMATON)["account"]] == ["12345678", "abcd1234"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["mailto:", "http://", "@", "a", "/", " ", "token", "is", "-", "x1", "1234", ":", "'"]), max_size=25))
def test_added_kinds_equal_a_search_from_every_anchor(parts):
    from wirefold.llm import pii
    text, low = "".join(parts), "".join(parts).lower()
    address, account, a_end, c_end = [], [], 0, 0
    for at, (kind, length) in AUTOMATON.iter(low):
        start = at - length + 1
        if kind == "scheme" and start >= a_end and (m := pii.AUTHORITY.match(text, at + 1)) and "@" in m.group()[1:-1]:
            a_end = m.end()
            address.append((start, a_end))
        if kind == "cue" and start >= c_end and not text[start - 1:start].isalnum() and text[start - 1:start] != "_":
            m = pii.CUE_VALUE.match(text, at + 1)
            if m and sum(c.isdigit() for c in m.group(1)) >= 4:
                c_end = m.end(1)
                account.append(m.span(1))
    found = find_spans(text, AUTOMATON)
    assert (found["address"], found["account"]) == (address, account)
