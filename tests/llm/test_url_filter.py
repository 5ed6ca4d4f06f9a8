import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wirefold.llm.url_filter import RULES, filter_urls

URLS = ["http://A.Example.org/en/1?x=1", "https://b.example.org/es/5#t", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/9",
        "http://notexample.org/es/1", "http://example.org", "http://ÄB.net/en/3", "nothing", "", None, "://", "http://u@h.net:80/a//b/",
        "http://h.net/" + "deep/" * 30, "http://h.net/?a://b/c", "ftp://com/de/", "http://h.net/" + "9" * 50_000]


def split_url(u):
    m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
    return ("", "") if not m else (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2])


def rule_of(host, path):
    best = None
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def brute(pages, labels, support, z, reject, tw=5.0, hw=10.0):
    bad = {}
    for i, b in labels:
        if i is not None and b is not None:
            bad[i] = max(b, bad.get(i, 0))
    rows = [(i, *split_url(u)) for i, u in pages]
    leaf = {}
    stats = defaultdict(lambda: [0, 0, 0])
    for i, h, p in rows:
        lex = re.sub("[0-9]+", "*", p)
        leaf[h, lex] = ""
        s = stats[h, lex]
        s[0] += 1
        if i in bad:
            s[1] += 1
            s[2] += bad[i]
    for level in range(max(len(k[1].split("/")) for k in leaf)):
        branch, node = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
        seg = {k: dict(enumerate(k[1].split("/")[1:])).get(level) for k in leaf}
        for k, t in leaf.items():
            if seg[k] is not None:
                for j in range(3):
                    branch[k[0], t, seg[k]][j] += stats[k][j]
                node[k[0], t][0] += stats[k][1]
                node[k[0], t][1] += stats[k][2]
        keep = set()
        for (h, t, g), (n, lab, b) in branch.items():
            share = (node[h, t][1] + 1) / (node[h, t][0] + 2)
            if n >= support and lab > 0 and abs(b - lab * share) >= z * (lab * share * (1 - share)) ** .5:
                keep.add((h, t, g))
        leaf = {k: t if seg[k] is None else t + "/" + (seg[k] if (k[0], t, seg[k]) in keep else "*") for k, t in leaf.items()}
    temp, host = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, t in leaf.items():
        for s in (temp[k[0], t], host[k[0]]):
            s[0] += stats[k][1]
            s[1] += stats[k][2]
    total = sum(s[0] for s in host.values())
    every = sum(s[1] for s in host.values()) / total if total else 0.0
    out = []
    for i, h, p in rows:
        t = leaf[h, re.sub("[0-9]+", "*", p)]
        prior = (host[h][1] + hw * every) / (host[h][0] + hw)
        purity = (temp[h, t][1] + tw * prior) / (temp[h, t][0] + tw)
        rule, verdict = rule_of(h, p)
        out.append((i, h, p, rule, verdict or ("block" if purity >= reject else "allow"), t))
    return Counter(out)


@pytest.fixture
def frames(spark):
    def make(pages, labels):
        return (spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, template string, host string"),
                spark.createDataFrame(labels, "page_id long, bad int"))
    return make


def test_equals_brute_force(frames):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (3, URLS[2]), (3, URLS[2])]
    labels = [(2, 1), (None, 1), (4, None), (2, 0)]
    for i in range(100, 700):
        part = ["spam", "news", "blog", f"p{i}"][i % 4]
        pages.append((i, f"http://h{i % 2}.net/{part}/x{'yz'[i % 5 == 0]}/{i}.html"))
        if i % 3:
            labels.append((i, int(part == "spam" or i % 17 == 0)))
    p, l = frames(pages, labels)
    got = filter_urls(p, l, min_support=5).select("page_id", "host", "path", "rule", "verdict", "template").collect()
    want = brute(pages, labels, 5, 2.0, 0.5)
    assert Counter(tuple(r) for r in got) == want
    assert any(r[5].startswith("/spam/") and r[4] == "block" and r[3] is None for r in want)


def test_a_deep_segment_tells_urls_apart(frames):
    pages = [(i, f"http://h.net/{'d/' * 11}{'spam' if i % 2 else 'news'}/{i}/{i % 3}.html") for i in range(200)]
    labels = [(i, i % 2) for i in range(0, 200, 3)]
    p, l = frames(pages, labels)
    got = filter_urls(p, l).select("page_id", "host", "path", "rule", "verdict", "template").collect()
    assert Counter(tuple(r) for r in got) == brute(pages, labels, 20, 2.0, 0.5)
    assert {(r["page_id"] % 2, r["verdict"]) for r in got} == {(0, "allow"), (1, "block")}
    assert {r["template"].split("/")[12] for r in got} == {"spam", "news"}


def test_empty_tables(frames):
    p, l = frames([], [])
    assert filter_urls(p, l).count() == 0
    p, l = frames([(1, "http://h.net/a")], [])
    assert [r["verdict"] for r in filter_urls(p, l).collect()] == ["allow"]


def test_native_plan(frames, capsys):
    p, l = frames([(1, "http://h.net/a")], [(1, 1)])
    filter_urls(p, l).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow"))
