"""Extractors on small landed documents."""
from pyspark.sql import functions as F

from wirefold.sources import extract as X


def test_link_filters(spark):
    anchors = ['<a href="/d">a long enough anchor text</a>', '<a href="//cdn/x">another long anchor text</a>',
               '<a href="http://q/">third long anchor text ok</a>', '<a href="d/e">relative long anchor text</a>',
               '<a href="#top">fragment long anchor text</a>', '<a href="/d">duplicate long anchor text</a>',
               '<a href="/z">Bu <b>uzun</b> satır</a>']
    page = spark.createDataFrame([(1, "https://a.b/c?x=1", "<html>" + "".join(anchors) + "</html>")],
                                 "source_id long, url string, body string")
    got = [r["url"] for r in X.page_links(page).orderBy("pos").collect()]
    assert got == ["https://a.b/d", "https://a.b//cdn/x", "http://q/"]


def test_limit_after_filter_on_pages(spark):
    anchors = ['<a href="/s">short</a>'] + [f'<a href="/p{i}">anchor number {i:02d} long</a>' for i in range(16)]
    page = spark.createDataFrame([(1, "https://h/", "".join(anchors))], "source_id long, url string, body string")
    assert X.page_links(page).count() == 15


def test_limit_before_filter_on_feeds(spark):
    items = ["<item><title>t0</title><link></link></item>"] + \
        [f"<item><title>t{i}</title><link>http://l/{i}</link></item>" for i in range(1, 16)]
    feed = spark.createDataFrame([(1, "<rss><channel>" + "".join(items) + "</channel></rss>")],
                                 "source_id long, body string")
    assert X.feed_items(feed).count() == 14
    bad = spark.createDataFrame([(2, "<rss><channel><item>")], "source_id long, body string")
    assert X.feed_items(bad).count() == 0


def test_mirror_failover(spark):
    att = spark.createDataFrame([("h", 0, 10), ("h", 1, 11), ("h", 2, 12), ("h", 3, 13)],
                                "handle string, mirror_rank int, source_id long")
    blocks = {11: "", 12: '<div class="timeline-item"><div class="tweet-content"> </div>'
                          '<a class="tweet-link" href="/a">x</a></div>',
              13: '<div class="timeline-item"><div class="tweet-content">hello</div>'
                  '<a class="tweet-link" href="/p/1">x</a></div>'}
    tl = spark.createDataFrame([(k, v) for k, v in blocks.items()], "source_id long, body string")
    posts = X.timeline_posts(tl)
    got = X.mirror_failover(posts, att).collect()
    assert [(r["mirror_rank"], r["source_id"]) for r in got] == [(3, 13)]
    assert posts.first()["url"] == "https://twitter.com/p/1"


def test_href_quoting_forms(spark):
    body = ('<a href="/dq">double quoted anchor text</a><a href=\'/sq\' id=x>single quoted anchor text</a>'
            '<a class=k href=/uq>unquoted href anchor text</a>')
    page = spark.createDataFrame([(1, "https://h.example/", body)], "source_id long, url string, body string")
    got = [r["url"] for r in X.page_links(page).orderBy("pos").collect()]
    assert got == ["https://h.example/dq", "https://h.example/sq", "https://h.example/uq"]


def test_atom_feed(spark):
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'
            '<entry><title>First post</title><link rel="alternate" href="http://a/1"/>'
            '<summary>&lt;p&gt;Hello&lt;/p&gt;</summary><updated>2024-01-01T00:00:00Z</updated></entry>'
            '<entry><title>Second</title><link rel="self" href="http://a/self"/><link href="http://a/2"/>'
            '<published>2024-01-02</published><updated>2024-01-03</updated></entry>'
            '<entry><title> </title><link href="http://a/3"/></entry></feed>')
    feed = spark.createDataFrame([(1, atom)], "source_id long, body string")
    got = [(r["title"], r["url"], r["content"], r["published_at"]) for r in X.feed_items(feed).orderBy("pos").collect()]
    assert got == [("First post", "http://a/1", "Hello", "2024-01-01T00:00:00Z"),
                   ("Second", "http://a/2", "", "2024-01-02")]


def test_anchor_attributes_in_real_markup(spark):
    body = ('<a data-href="/wrong" href="/right">data-href is not href here</a>'
            '<a title="a > b" href=/quoted>greater-than inside a value</a>'
            "<a title='href=/no' class=x href='/single'>a name inside a value</a>"
            '<a name="x">an anchor without href here</a><abbr href="/no">not an anchor at all</abbr>'
            '<A HREF="/upper">T&uuml;rkiye &ccedil;ok g&uuml;zel &#38;lt;b</A>')
    page = spark.createDataFrame([(1, "https://h.example/", body)], "source_id long, url string, body string")
    got = [(r["url"].removeprefix("https://h.example"), r["title"]) for r in X.page_links(page).orderBy("pos").collect()]
    assert got == [("/right", "data-href is not href here"), ("/quoted", "greater-than inside a value"),
                   ("/single", "a name inside a value"), ("/upper", "Türkiye çok güzel &lt;b")]


def test_timeline_elements_by_class_token(spark):
    body = ('<p>head</p><div class="timeline-item "><div class="tweet-content media-body">outer <div>inner</div> tail</div>'
            '<a href="/p/1" class="tweet-link">x</a></div>'
            "<div id=a class='show timeline-item'><span class='tweet-content'>plain &amp; short</span>"
            "<a data-href='/no' class='tweet-link b' href='/p/2'>x</a><div>after</div></div>"
            '<div class="timeline-items"><div class="tweet-content">not an item</div></div>'
            '<div class="timeline-item"><div class="not-tweet-content">no</div><a class="tweet-link" href="/p/3">x</a></div>')
    tl = spark.createDataFrame([(1, body)], "source_id long, body string")
    got = [(r["content"], r["url"]) for r in X.timeline_posts(tl).orderBy("pos").collect()]
    assert got == [("outer inner tail", "https://twitter.com/p/1"), ("plain & short", "https://twitter.com/p/2")]


def test_rss_1_items_beside_the_channel(spark):
    rdf = ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>c</title></channel>'
           '<item><title>One</title><link>http://l/1</link><description>d</description></item>'
           '<item><title>Two</title><link>http://l/2</link></item></rdf:RDF>')
    feed = spark.createDataFrame([(1, rdf)], "source_id long, body string")
    assert [(r["title"], r["url"], r["content"]) for r in X.feed_items(feed).orderBy("pos").collect()] == [
        ("One", "http://l/1", "d"), ("Two", "http://l/2", "")]


def test_dispatch_guards_and_failover(spark):
    post = lambda n: ('<div class="timeline-item"><div class="tweet-content">post %s</div>'  # noqa: E731
                      '<a class="tweet-link" href="/p/%s">x</a></div>' % (n, n))
    link = '<a href="/x">a long enough anchor text</a>'
    sources = spark.createDataFrame(
        [(1, "x", True, None, "@u"), (2, "x", True, None, None), (3, "web", True, None, None), (4, "web", True, "https://h/", None),
         (5, "web", False, "https://i/", None), (6, "atom", True, "https://j/", None), (7, "x", True, None, "@@")],
        "id long, source_type string, active boolean, url string, x_handle string")
    landing = spark.createDataFrame(
        [(1, "x", 0, 503, post("zero")), (1, "x", 1, 200, "<p>none</p>"), (1, "x", 2, 200, post("two")), (1, "x", 3, 200, post("three")),
         (2, "x", 0, 200, post("no")), (3, "web", 0, 200, link), (4, "web", 0, 200, link), (5, "web", 0, 200, link),
         (6, "atom", 0, 200, link), (7, "x", 0, 200, post("no")), (8, "web", 0, 200, link)],
        "source_id long, source_type string, mirror_rank int, status int, body string")
    got = sorted((r["source_id"], r["url"]) for r in X.fetch_all_active(sources, landing).collect())
    assert got == [(1, "https://twitter.com/p/two"), (4, "https://h/x")]
    late = landing.filter("source_id = 1").withColumn("mirror_rank", F.col("mirror_rank") + 2)
    assert X.fetch_all_active(sources, late).count() == 0      # the good mirror is the fifth
