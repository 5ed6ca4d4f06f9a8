"""Item extraction from landed documents: feeds, web pages and timeline pages.

Input is a landing table of fetched bodies (the download itself is outside:
status and body are columns). Each extractor is a narrow, per-row plan over
built-in functions (``from_xml``, regex arrays, ``posexplode``) followed by
small per-document windows, so a partition of landed documents is processed
in one whole-stage pipeline and documents never leave their partition until
the per-document limits.

Every item carries ``(source_type, source_id, pos)``: the arrival order that
all later first-wins rules use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions import markup as M
from wirefold.functions import text as T
from wirefold.session import stored

FEED_LIMIT = 15
PAGE_LIMIT = 15
POST_LIMIT = 10

# RSS 2.0 (channel/item), RSS 1.0 (items beside the channel) and Atom (entry,
# link/@href) in one schema: the root element is ignored, so one parse serves
# all and the other sides are NULL.
_ITEM = ("ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, summary: STRING, pubDate: STRING, "
         "date: STRING, updated: STRING>>")
FEED_SCHEMA = (f"channel STRUCT<item: {_ITEM}>, item {_ITEM}, "
               "entry ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, "
               "summary: STRING, published: STRING, updated: STRING>>")

POST_BLOCK, POST_CONTENT, POST_LINK = "timeline-item", "tweet-content", "tweet-link"
#: Put before a block's first part (no character of HTML).
BLOCK = "\x03"

ITEM_COLUMNS = ["source_type", "source_id", "pos", "title", "content", "url",
                "published_at", "is_column"]


def landed_ok(landing: DataFrame, status_col: str = "status") -> DataFrame:
    """Only a 200 response gives a document; anything else gives none."""
    return landing.filter(F.col(status_col) == 200)


def feed_items(feeds: DataFrame, limit: int = FEED_LIMIT, id_col: str = "source_id",
               body_col: str = "body", keywords=T.COLUMN_KEYWORDS) -> DataFrame:
    """RSS items: first ``limit`` entries (limit **before** the filters), skip
    entries without link or (stripped) title; content = summary, else
    description, as text, cleaned; published = pubDate, else updated.
    Malformed XML parses to NULL and gives no items."""
    parsed = feeds.select(F.col(id_col).alias("source_id"),
                          F.from_xml(F.col(body_col), FEED_SCHEMA).alias("f"))

    def atom(en):
        # the entry's page link: first link with no rel or rel="alternate"
        alt = F.filter(en["link"], lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
        return F.struct(en["title"].alias("title"), F.element_at(alt, 1)["_href"].alias("link"),
                        F.lit(None).cast("string").alias("description"), en["summary"].alias("summary"),
                        en["published"].alias("pubDate"), en["updated"].alias("updated"))

    def rss(it):
        # the dates of RSS 1.0 are Dublin Core's
        return F.struct(it["title"].alias("title"), it["link"].alias("link"), it["description"].alias("description"),
                        it["summary"].alias("summary"), T.first_nonempty(it["pubDate"], it["date"]).alias("pubDate"),
                        it["updated"].alias("updated"))

    entries = F.coalesce(F.transform(F.col("f.channel.item"), rss), F.transform(F.col("f.item"), rss),
                         F.transform(F.col("f.entry"), atom))
    e = parsed.select("source_id", F.posexplode_outer(entries).alias("pos", "it")) \
        .filter(F.col("it").isNotNull() & (F.col("pos") < limit))
    title = T.ws_trim(T.blank_to_empty(F.col("it.title")))
    link = T.blank_to_empty(F.col("it.link"))
    body = T.first_nonempty(F.col("it.summary"), F.col("it.description"))
    items = e.select(
        F.lit("rss").alias("source_type"), "source_id", "pos",
        title.alias("title"),
        F.when(body != "", T.clean_text(M.html_to_text(body))).otherwise(F.lit("")).alias("content"),
        link.alias("url"),
        F.nullif(T.first_nonempty(F.col("it.pubDate"), F.col("it.updated")), F.lit("")).alias("published_at"),
    ).filter((F.col("url") != "") & (F.col("title") != ""))
    return items.withColumn("is_column", T.keyword_flag(F.col("url"), F.col("title"), keywords)) \
        .select(*ITEM_COLUMNS)


def anchors(pages: DataFrame, id_col: str = "source_id", url_col: str = "url",
            body_col: str = "body") -> DataFrame:
    """(source_id, page_url, pos, href, text): every anchor with an href, in
    document order; text = decoded, stripped text nodes joined with ''. One
    pass over a page cuts it at its anchors; the rest reads those short parts."""
    parts = F.transform(M.anchor_parts(F.col(body_col)), lambda p: F.struct(
        M.attribute(M.part_tag(p), "href").alias("href"), p.alias("part")))
    a = pages.select(F.col(id_col).alias("source_id"), F.col(url_col).alias("page_url"),
                     F.posexplode(F.filter(parts, lambda x: x["href"].isNotNull())).alias("pos", "a"))
    return a.select("source_id", "page_url", "pos", T.decode_entities(F.col("a.href")).alias("href"),
                    M.node_text_joined(M.part_rest(F.col("a.part"))).alias("text"))


def page_links(pages: DataFrame, limit: int = PAGE_LIMIT, min_title: int = T.MIN_LINK_TITLE,
               id_col: str = "source_id", url_col: str = "url", body_col: str = "body",
               keywords=T.COLUMN_KEYWORDS) -> DataFrame:
    """Web items: anchors whose text has >= ``min_title`` chars, href resolved
    against the page's ``scheme://host``, kept if it starts with 'http',
    first occurrence per URL in the page, then the first ``limit`` (limit
    **after** the filters)."""
    return links_of(anchors(pages, id_col, url_col, body_col), limit, min_title, keywords)


def links_of(a: DataFrame, limit: int = PAGE_LIMIT, min_title: int = T.MIN_LINK_TITLE,
             keywords=T.COLUMN_KEYWORDS) -> DataFrame:
    """``page_links`` from the rows of ``anchors``."""
    a = a.filter((F.col("text") != "") & (F.length("text") >= min_title)) \
        .withColumn("link", T.resolve_link(F.col("href"), F.col("page_url"))) \
        .filter(F.col("link").startswith("http"))
    first = Window.partitionBy("source_id", "link").orderBy("pos")
    a = a.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") == 1)
    per_page = Window.partitionBy("source_id").orderBy("pos")
    a = a.withColumn("_n", F.row_number().over(per_page)).filter(F.col("_n") <= limit)
    return a.select(
        F.lit("web").alias("source_type"), "source_id", "pos",
        F.col("text").alias("title"), F.lit("").alias("content"), F.col("link").alias("url"),
        F.lit(None).cast("string").alias("published_at"),
        T.keyword_flag(F.col("link"), F.col("text"), keywords).alias("is_column"))


def timeline_blocks(timelines: DataFrame, id_col: str = "source_id",
                    body_col: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, *keep, pos, parts): the timeline item blocks in page order,
    each as its parts (a unit of markup and the text behind it). A block
    reaches up to the next one's start."""
    starts = lambda p: ~p.startswith("</") & M.has_class(M.part_tag(p), POST_BLOCK)
    parts = F.transform(M.marked_parts(F.translate(F.col(body_col), BLOCK, "")),
                        lambda p: F.when(starts(p), F.concat(F.lit(BLOCK), p)).otherwise(p))
    blocks = F.split(F.array_join(parts, M.OPEN), BLOCK)
    return (timelines.select(F.col(id_col).alias("source_id"), *keep,
                             F.posexplode(F.slice(blocks, 2, 1 << 30)).alias("pos", "block"))
            .select("source_id", *keep, "pos", F.split("block", M.OPEN).alias("parts")))


def post_links(parts) -> Column:
    """The parts of a block that are post links."""
    return F.filter(parts, lambda p: F.lower(F.substring(p, 1, 2)).eqNullSafe("<a") & M.has_class(M.part_tag(p), POST_LINK)
                    & F.regexp_like(p, F.lit(r"^<[aA][\s/]")))


def timeline_posts(timelines: DataFrame, limit: int = POST_LIMIT, id_col: str = "source_id",
                   body_col: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Posts: first ``limit`` blocks (limit **before** the filters); a block
    needs a content element and a post link; content is its text, cleaned,
    and must be non-empty; title = first 100 chars (+ ellipsis); url = the
    link path on the post host. Never flagged as a column. Elements are found
    by class token, whatever the order of attributes."""
    b = timeline_blocks(timelines, id_col, body_col, keep).filter(F.col("pos") < limit)
    # out of an array of one, so that the filter doesn't find them again
    found = F.struct(T.clean_text(M.element_text(F.col("parts"), POST_CONTENT)).alias("content"),
                     F.get(post_links("parts"), F.lit(0)).alias("link"))
    b = b.select("source_id", *keep, "pos", F.explode(F.array(found)).alias("x"))
    b = b.filter(F.col("x.link").isNotNull() & (F.col("x.content") != ""))
    b = b.select("source_id", *keep, "pos", F.col("x.content").alias("content"),
                 T.decode_entities(M.attribute(M.part_tag(F.col("x.link")), "href")).alias("path"))
    return b.select(
        F.lit("x").alias("source_type"), "source_id", *keep, "pos",
        T.truncate_title(F.col("content")).alias("title"), "content",
        T.rewrite_path(F.col("path")).alias("url"),
        F.lit(None).cast("string").alias("published_at"), F.lit(False).alias("is_column"))


def mirror_failover(items: DataFrame, attempts: DataFrame, mirrors: int = T.MIRRORS) -> DataFrame:
    """Pick, per handle, the first mirror (by rank, at most ``mirrors`` tried)
    that yields at least one valid item; a 200 page without items does not
    count. ``attempts`` is (handle, mirror_rank, source_id); ``items`` has a
    ``source_id`` per item. Returns (handle, mirror_rank, source_id, n_items)."""
    counts = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_items"))
    good = attempts.filter(F.col("mirror_rank") < mirrors).join(counts, "source_id") \
        .filter(F.col("n_items") > 0)
    best = good.groupBy("handle").agg(F.min(F.struct("mirror_rank", "source_id", "n_items")).alias("m"))
    return best.select("handle", F.col("m.mirror_rank").alias("mirror_rank"),
                       F.col("m.source_id").alias("source_id"), F.col("m.n_items").alias("n_items"))


#: Characters of timelines that one task reads.
TASK_CHARS = 4_000_000


def dealt_bodies(landed: DataFrame, task_chars: int = TASK_CHARS) -> DataFrame:
    """``landed`` (source_id, mirror_rank, body), written, in as many tasks as its text
    needs. Bodies alike are a few bytes of a shuffle, by which tasks are merged
    otherwise: one then reads more text the more there is."""
    landed = stored(landed.select("source_id", "mirror_rank", "body"))
    chars = landed.agg(F.sum(F.length("body"))).first()[0] or 0
    return landed.repartition(max(1, -(-chars // task_chars)), "source_id")


def fetch_all_active(sources: DataFrame, landing: DataFrame, mirrors: int = T.MIRRORS) -> DataFrame:
    """Dispatch landed bodies by source type (rss, web, x; anything else gives
    nothing), for active sources only, and concatenate; the order of arrival
    is ``(source_type, source_id, pos)``.

    ``sources``: id, source_type, active, url, x_handle. ``landing``:
    source_id, source_type, mirror_rank, status, body. A feed or page without
    a url and a timeline without a handle give nothing. Of a timeline's
    mirrors the first (of ``mirrors``) with any post counts."""
    act = sources.filter(F.col("active")).select(
        F.col("id").alias("source_id"), F.col("source_type").alias("of_type"), F.col("url").alias("src_url"),
        T.strip_handle(T.blank_to_empty("x_handle")).alias("handle"))

    def landed(kind: str, wanted) -> DataFrame:
        # the type is in landing, so each branch reads the bodies of its own type
        mine = landed_ok(landing).filter(F.col("source_type") == kind).drop("source_type")
        return mine.join(act.filter((F.col("of_type") == kind) & wanted).drop("of_type"), "source_id")

    has_url = T.blank_to_empty("src_url") != ""
    rss = feed_items(landed("rss", has_url))
    web = page_links(landed("web", has_url), url_col="src_url")
    lines = dealt_bodies(landed("x", F.col("handle") != "").filter(F.col("mirror_rank") < mirrors))
    posts = timeline_posts(lines, keep=("mirror_rank",))
    # at most ``mirrors`` x ``POST_LIMIT`` posts per source
    first = F.min("mirror_rank").over(Window.partitionBy("source_id"))
    x = posts.withColumn("first", first).filter(F.col("mirror_rank") == F.col("first")).select(*ITEM_COLUMNS)
    return rss.unionByName(web).unionByName(x)
