"""Markup scanning: no page may cost more than its length, in time or in stack."""
import html
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from wirefold.functions import markup as M
from wirefold.plans import sqltext as Q
from wirefold.sources import extract as X

MB = 1_000_000
POST = '<div class="timeline-item"><div class="tweet-content">hello</div><a class="tweet-link" href="/p/1">x</a></div>'
LINK = '<a href="/x">a long enough anchor text</a>'

HOSTILE = {
    "many attributes": "<p " + 'x="1" ' * 100_000 + ">text</p>" + LINK + POST,
    "unbalanced quote": '<p title="' + "<b>x</b>" * 10_000 + LINK + POST,
    "unbalanced quote without value": '<p "' + "<b>x</b>" * 10_000 + LINK + POST,
    "unclosed anchors": '<a href="/y">' * (MB // 13) + LINK + POST,
    "unclosed tags": "<a " * (MB // 3),
    "unclosed quotes": '<a x="' * (MB // 6),
    "alternating quotes": "<a x=\"'>" * (MB // 8),
    "unclosed comments": LINK + POST + "<!--" * (MB // 4),
    "unclosed scripts": LINK + POST + "<script>" * (MB // 8),
    "half closed scripts": LINK + POST + "<script>" + "</script " * (MB // 9),
    "only brackets": "<" * MB + LINK + POST,
    "equal signs": "<a " + "=" * MB + ">" + LINK + POST,
    "spaces": "<a" + " " * MB + ">" + LINK + POST,
    "open elements": "<div class=timeline-item><div class=tweet-content>" + "<div>" * 100_000 + "deep",
    "class tokens": '<p class="' + "timeline-item-x " * 50_000 + '">' + LINK + POST,
    "ampersands": "&" * MB + LINK + POST,
}


RUNS = {"text": lambda page: page.select(F.length(M.html_to_text("body"))), "links": X.page_links, "posts": X.timeline_posts}


@pytest.mark.parametrize("kind", RUNS)
def test_no_page_is_slow_or_ends_the_jvm(spark, kind):
    """Each hostile page in a job of its own file; the time of a small page's job is what planning costs."""
    seconds = {}
    for name, body in [("small", LINK + POST), ("small", LINK + POST), *HOSTILE.items()]:
        page = spark.createDataFrame([(1, "https://h/", body)], "source_id long, url string, body string").cache()
        page.count()
        start = time.time()
        RUNS[kind](page).collect()
        seconds[name] = time.time() - start
        page.unpersist()
    slow = {n: s for n, s in seconds.items() if s > 3 + seconds["small"]}
    assert not slow


def test_what_hostile_pages_give(spark):
    rows = [(i, "https://h/", HOSTILE[n]) for i, n in enumerate(HOSTILE)]
    pages = spark.createDataFrame(rows, "source_id long, url string, body string")
    names = list(HOSTILE)
    links = {names[r["source_id"]] for r in X.page_links(pages).collect() if r["url"] == "https://h/x"}
    posts = {names[r["source_id"]] for r in X.timeline_posts(pages).collect()}
    swallowed = {"unclosed tags", "unclosed quotes", "alternating quotes", "open elements"}  # hold no link of their own
    assert links == set(HOSTILE) - swallowed - {"unbalanced quote"}
    assert posts == links | {"unbalanced quote"}  # that quote reaches the next one, in the link before the post


TRICKY = ["", "a < b > c", "x <3 y", "<p>a<!-- <b> -->b</p>", "<!-->t", "<!--->t", "<!-- a --!>t", "<!-- open", "a<script>if (a<b) x('</p>')</script>b",
          "a<SCRIPT src='>'>x</SCRIPT >b", "<style>p{}</style/>x", "<scripty>text</scripty>", "<p title='a > b'>t", '<p title="it\'s">t', "<p title=it's>t",
          '<a href="x>y', "<a href=x", "</a", "<a>b</a>", "<A HREF=/u>up</A>", "<a href=/1>one<a href=/2>two</a>", "<a href=/1>one<p>x</p>",
          "<a\nhref='/n'>n&amp;l</a>", "<abbr href=/no>x</abbr>", "<a/href=/s>s</a>", "a\x01b\x02<a href=/c>\x01c\x02</a>", "<?php a > b ?>t",
          "<a title='<a href=/in>' href=/out>o</a>", "<!-- <a href=/c>c</a> --><a href=/d>d</a>", "<a href=/e>x<!-- c -->y</a>", "<a href=''>e</a>", "< a href=/x>t</a>"]


def test_patterns_agree_with_the_oracle_engine(spark):
    frame = spark.createDataFrame(list(enumerate(TRICKY)), "source_id long, body string").withColumn("page_url", F.lit("https://h/"))
    text = {r["source_id"]: r["t"] for r in frame.select("source_id", M.html_to_text("body").alias("t")).collect()}
    anchors = sorted(tuple(r) for r in X.anchors(frame, url_col="page_url").select("source_id", "pos", "href", "text").collect())
    with duckdb.connect() as c:
        c.execute("CREATE TABLE t (source_id BIGINT, body VARCHAR, page_url VARCHAR)")
        c.executemany("INSERT INTO t VALUES (?, ?, 'https://h/')", list(enumerate(TRICKY)))
        assert dict(c.sql(f"SELECT source_id, {Q.html_to_text('body')} FROM t").fetchall()) == text
        sql = Q.anchors_ctes("SELECT source_id, page_url, body FROM t")
        assert sorted(c.sql(f"WITH {sql} SELECT source_id, pos, href, text FROM anchors").fetchall()) == anchors
    found = {}
    for i, _, href, inner in anchors:
        found.setdefault(TRICKY[i], []).append((href, inner))
    assert found["<a href=/1>one<a href=/2>two</a>"] == [("/1", "one"), ("/2", "two")]
    assert found["<!-- <a href=/c>c</a> --><a href=/d>d</a>"] == [("/d", "d")]
    assert found["<a title='<a href=/in>' href=/out>o</a>"] == [("/out", "o")]
    assert found["<a href=/e>x<!-- c -->y</a>"] == [("/e", "xy")]
    assert text[TRICKY.index("a<script>if (a<b) x('</p>')</script>b")] == "a b"
    assert text[TRICKY.index("<!-- open")] == " "


def test_text_of_plain_markup(spark):
    body = "<div class='k'><p>A &amp; B</p><br/><ul><li>x</li></ul></div>"
    got = spark.range(1).select(M.html_to_text(F.lit(body)).alias("t")).first()["t"]
    assert got.split() == html.unescape("A &amp; B x").split()
