"""Landing tables built from the given test tables, so that the extractors run
over data whose size grows with the tables.

- web pages: ``pages`` as they are (status 200 unless the page is cut off);
- feeds: ``documents`` grouped 20 per feed in ``doc_id`` order, as RSS XML;
- timelines: ``conversations`` cut into pages of 20 turns per ``conv_id``,
  one block per turn in varying markup (class lists, nested elements, other
  attribute orders), system turns without a post link, on several mirrors:
  those before the good one fail or are empty, the one after it must not count.

Some sources are inactive, of an unknown type, or lack their url or handle.

Groups are bounded (20 documents, 20 turns), so no group grows with the data,
even when one conversation holds a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.sources.tables import table

FEED_SIZE = 20
RSS_ID_BASE = 1_000_000_000
X_ID_BASE = 2_000_000_000
TIMELINE_PAGE = 20
X_PAGE_STRIDE = 1_000_000   # source id = X_ID_BASE + conv_id * stride + page number
XML_INVALID = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"


def xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def doc_feed_fields(d: DataFrame) -> DataFrame:
    """Per document: feed id, title (first line), link, body and date."""
    text = F.regexp_replace(F.col("text"), XML_INVALID, "")
    return d.select(
        F.floor(F.col("doc_id") / FEED_SIZE).cast("long").alias("feed_id"), "doc_id", "lang",
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"),
        F.when(F.col("lang") == "de", F.lit(""))
        .otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/doc/"),
                            F.col("doc_id").cast("string"))).alias("link"),
        F.concat(F.lit("<p>"), text, F.lit("</p>")).alias("description"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("pub"))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, feed_id, status, body): RSS documents, 20 items each."""
    f = doc_feed_fields(table(spark, sf_dir, "documents"))
    item = F.concat(F.lit("<item><title>"), xml_escape(F.col("title")), F.lit("</title><link>"),
                    xml_escape(F.col("link")), F.lit("</link><description>"),
                    xml_escape(F.col("description")), F.lit("</description><pubDate>"),
                    F.col("pub"), F.lit("</pubDate></item>"))
    g = f.groupBy("feed_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("x")))).alias("xs"))
    return g.select(
        (F.col("feed_id") + RSS_ID_BASE).alias("source_id"), "feed_id", F.lit(200).alias("status"),
        F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>'),
                 F.array_join(F.transform("xs", lambda x: x["x"]), ""),
                 F.lit("</channel></rss>")).alias("body"))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, url, status, body): a page cut off before ``</html>`` is
    taken as a failed fetch (status 500)."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("source_id"), "url",
                    F.when(F.col("html").contains("</html>"), F.lit(200)).otherwise(F.lit(500)).alias("status"),
                    F.col("html").alias("body"))


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, conv_id, status, body): timeline pages of 20 turns."""
    c = table(spark, sf_dir, "conversations").withColumn(
        "page_no", F.floor(F.col("turn") / TIMELINE_PAGE).cast("long"))
    path = F.concat(F.lit("/u"), F.col("conv_id").cast("string"), F.lit("/status/"), F.col("turn").cast("string"))
    form = F.pmod(F.col("turn"), F.lit(3))
    link = (F.when(F.col("role") == "system", F.lit(""))
            .when(form == 0, F.concat(F.lit('<a class="tweet-link" href="'), path, F.lit('">#</a>')))
            .when(form == 1, F.concat(F.lit("<a data-href='/wrong' title='a > b' href='"), path, F.lit("' class='x tweet-link'>#</a>")))
            .otherwise(F.concat(F.lit('<a href="'), path, F.lit('" class="tweet-link ">#</a>'))))
    text = xml_escape(F.col("text"))
    body = (F.when(form == 0, F.concat(F.lit('<div class="tweet-content">'), text, F.lit("</div>")))
            .when(form == 1, F.concat(F.lit('<div dir="auto" class="tweet-content media-body"><div>'), text,
                                      F.lit("</div><div> </div></div><div>likes</div>")))
            .otherwise(F.concat(F.lit("<p class='media tweet-content'>"), text, F.lit("</p>"))))
    block = F.concat(F.when(form == 2, F.lit('<li id="i" class="timeline-item ">')).otherwise(F.lit('<div class="timeline-item">')),
                     body, link, F.when(form == 2, F.lit("</li>")).otherwise(F.lit("</div>")))
    g = c.groupBy("conv_id", "page_no").agg(
        F.sort_array(F.collect_list(F.struct("turn", block.alias("x")))).alias("xs"))
    return g.select(
        (F.lit(X_ID_BASE) + F.col("conv_id") * X_PAGE_STRIDE + F.col("page_no")).alias("source_id"),
        "conv_id", F.lit(200).alias("status"),
        F.concat(F.lit('<html><body><div class="timeline">'),
                 F.array_join(F.transform("xs", lambda x: x["x"]), ""),
                 F.lit("</div></body></html>")).alias("body"))


def mirrored(x: DataFrame) -> DataFrame:
    """Landed bodies of each timeline page by mirror: the good one is
    ``conv_id`` mod 3; those before it fail or have no item, the next one has
    another text."""
    good = F.pmod(F.col("conv_id"), F.lit(3))
    tried = x.withColumn("mirror_rank", F.explode(F.sequence(F.lit(0).cast("long"), good + 1)))
    early, late = F.col("mirror_rank") < good, F.col("mirror_rank") > good
    return tried.select(
        "source_id", F.col("mirror_rank").cast("int").alias("mirror_rank"),
        F.when(early & (F.pmod("conv_id", F.lit(2)) == 0), F.lit(503)).otherwise(F.lit(200)).alias("status"),
        F.when(early, F.lit("<html><body>nothing here</body></html>"))
        .when(late, F.regexp_replace("body", "/status/", "/late/")).otherwise(F.col("body")).alias("body"))


def landing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sources, landing) for the dispatcher: a source per page, feed and timeline page."""
    w = web_pages(spark, sf_dir)
    f = feeds(spark, sf_dir)
    x = timelines(spark, sf_dir)
    none = F.lit(None).cast("string")
    page_no = F.col("source_id")
    web_type = F.when(F.pmod(page_no, F.lit(17)) == 7, F.lit("atom")).otherwise(F.lit("web"))
    feed_url = F.concat(F.lit("https://feeds.example.org/"), F.col("feed_id").cast("string"))
    sources = (w.select(page_no.alias("id"), F.concat(F.lit("page-"), page_no.cast("string")).alias("name"),
                        web_type.alias("source_type"), F.when(F.pmod(page_no, F.lit(13)) != 5, F.col("url")).alias("url"),
                        none.alias("x_handle"), (F.pmod(page_no, F.lit(11)) != 3).alias("active"))
               .unionByName(f.select(F.col("source_id").alias("id"),
                                     F.concat(F.lit("feed-"), F.col("feed_id").cast("string")).alias("name"),
                                     F.lit("rss").alias("source_type"),
                                     F.when(F.pmod("feed_id", F.lit(9)) == 4, F.lit("")).otherwise(feed_url).alias("url"),
                                     none.alias("x_handle"), F.lit(True).alias("active")))
               .unionByName(x.select(F.col("source_id").alias("id"),
                                     F.concat(F.lit("@u"), F.col("conv_id").cast("string")).alias("name"),
                                     F.lit("x").alias("source_type"), none.alias("url"),
                                     F.when(F.pmod("conv_id", F.lit(7)) != 3, F.concat(F.lit("@u"), F.col("conv_id").cast("string")))
                                     .alias("x_handle"), F.lit(True).alias("active"))))
    first = F.lit(0).alias("mirror_rank")
    land = (w.select("source_id", web_type.alias("source_type"), first, "status", "body")
            .unionByName(f.select("source_id", F.lit("rss").alias("source_type"), first, "status", "body"))
            .unionByName(mirrored(x).withColumn("source_type", F.lit("x"))))
    return sources, land
