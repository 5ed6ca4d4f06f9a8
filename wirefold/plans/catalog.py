"""Registered queries: one Spark plan per operator over the given test tables,
each with its DuckDB oracle SQL where the exact answer is expressible in SQL.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame; computed
columns carry the same names in the Spark result and in the SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.functions import markup as M
from wirefold.functions import text as T
from wirefold.operators import dedup as D
from wirefold.operators import select as SEL
from wirefold.operators import similarity as S
from wirefold.plans import sqltext as Q
from wirefold.session import cut_lineage, ensure_checkpoint_dir, stored
from wirefold.sources import tables as TB

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


CHAT = TB.DEFAULT_CHAT
THRESHOLD = S.SIMILARITY_THRESHOLD

# ---------------------------------------------------------------------------
# Selection: C1, C2, F1, F2, D1, A1
# ---------------------------------------------------------------------------
_NEWS_SQL = """
_n AS (SELECT o.o_orderkey AS id, o.o_custkey AS source_id, o.o_orderdate AS fetched_at,
              c.c_name AS source_name
       FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)"""


@register("news_with_source", f"WITH {_NEWS_SQL} SELECT id, source_id, fetched_at, source_name FROM _n")
def q_news_with_source(spark, sf):
    return SEL.with_source(TB.news_orders(spark, sf), TB.sources_large(spark, sf)) \
        .select("id", "source_id", "fetched_at", "source_name")


@register("unsent_news", f"""
WITH {_NEWS_SQL}
SELECT id, source_id, fetched_at, source_name FROM _n
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = _n.id AND l.l_returnflag = '{CHAT}')
ORDER BY fetched_at DESC, id DESC LIMIT 50""")
def q_unsent_news(spark, sf):
    return SEL.unsent_news(TB.news_orders(spark, sf), TB.sources_large(spark, sf),
                           TB.sent_lineitem(spark, sf), CHAT) \
        .select("id", "source_id", "fetched_at", "source_name")


@register("unsent_per_chat", f"""
WITH {_NEWS_SQL},
_chats AS (SELECT DISTINCT l_returnflag AS chat_id FROM lineitem),
_p AS (SELECT ch.chat_id, _n.* FROM _chats ch JOIN _n ON true
       WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = _n.id AND l.l_returnflag = ch.chat_id))
SELECT chat_id, "rank", id, source_id, fetched_at, source_name FROM (
  SELECT _p.*, row_number() OVER (PARTITION BY chat_id ORDER BY fetched_at DESC, id DESC) AS "rank" FROM _p)
WHERE "rank" <= 50""")
def q_unsent_per_chat(spark, sf):
    sent = TB.sent_lineitem(spark, sf)
    return SEL.unsent_per_chat(TB.news_orders(spark, sf), TB.sources_large(spark, sf), sent,
                               SEL.chats_of(sent)) \
        .select("chat_id", "rank", "id", "source_id", "fetched_at", "source_name")


_SOURCES_SQL = """
_src AS (SELECT s_suppkey AS id, s_name AS name,
                ['rss', 'web', 'x'][(s_suppkey % 3) + 1] AS source_type,
                (s_suppkey % 5) <> 0 AS active FROM supplier)"""


@register("list_sources", f"""
WITH {_SOURCES_SQL}
SELECT id, name, source_type, active FROM _src WHERE active ORDER BY source_type, id""")
def q_list_sources(spark, sf):
    return SEL.list_sources(TB.sources_small(spark, sf), only_active=True) \
        .select("id", "name", "source_type", "active")


@register("count_recent", """
SELECT count(*) AS n_recent FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def q_count_recent(spark, sf):
    ev = TB.table(spark, sf, "events")
    now = ev.agg(F.max("ts")).scalar()
    return SEL.count_recent(ev, now, 24, ts_col="ts")


# ---------------------------------------------------------------------------
# Text and TF-IDF: B1, B2, B3, H1-H8, D5, D6, E4
# ---------------------------------------------------------------------------
@register("normalize_text", f"SELECT doc_id, {Q.norm('text')} AS norm FROM documents")
def q_normalize_text(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", T.normalize("text").alias("norm"))


@register("build_corpus", f"""
SELECT doc_id, {Q.corpus("split_part(text, chr(10), 1)", 'text')} AS corpus FROM documents""")
def q_build_corpus(spark, sf):
    d = TB.table(spark, sf, "documents")
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return d.select("doc_id", T.corpus_text(title, F.col("text")).alias("corpus"))


@register("clean_text", f"SELECT conv_id, turn, {Q.clean('text')} AS clean FROM conversations")
def q_clean_text(spark, sf):
    return TB.table(spark, sf, "conversations").select("conv_id", "turn", T.clean_text("text").alias("clean"))


@register("tokenize", f"""
SELECT doc_id, len(list_filter(string_split({Q.norm('text')}, ' '), lambda x: length(x) >= 2)) AS n_tokens,
       array_to_string(list_filter(string_split({Q.norm('text')}, ' '), lambda x: length(x) >= 2), ' ') AS tokens
FROM documents""")
def q_tokenize(spark, sf):
    d = TB.table(spark, sf, "documents").select("doc_id", T.tokens(T.normalize("text")).alias("toks"))
    return d.select("doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


@register("ngrams", f"""
WITH _t AS (SELECT doc_id, list_filter(string_split({Q.norm('text')}, ' '), lambda x: length(x) >= 2) AS t FROM documents),
_g AS (SELECT doc_id, list_concat(t, list_transform(list_zip(t[1:len(t) - 1], t[2:]), lambda z: z[1] || ' ' || z[2])) AS g FROM _t)
SELECT doc_id, len(g) AS n_terms, len(list_distinct(g)) AS n_distinct, g[-1] AS last_term FROM _g""")
def q_ngrams(spark, sf):
    d = (TB.table(spark, sf, "documents").select("doc_id", T.tokens(T.normalize("text")).alias("toks"))
         .select("doc_id", T.ngram_terms(F.col("toks")).alias("terms")))
    return d.select("doc_id", F.size("terms").alias("n_terms"),
                    F.size(F.array_distinct("terms")).alias("n_distinct"),
                    F.get("terms", F.size("terms") - 1).alias("last_term"))  # NULL for a text without terms


def _doc_items(spark, sf):
    return TB.news_documents(spark, sf)


def _docs(items, *keep):
    return items.select("batch", "pos", T.corpus_text(F.lit(None).cast("string"), F.col("text")).alias("norm"), *keep)


def _dealt(docs):
    return S.dealt(stored(docs))


_ITEMS = Q.doc_items()


@register("term_freq", f"""
WITH {_ITEMS}, {Q.tfidf_ctes('items')}
SELECT i.doc_id, t.term, t.tf FROM _tf t JOIN items i ON i.batch = t.batch AND i.pos = t.pos""")
def q_term_freq(spark, sf):
    items = _doc_items(spark, sf)
    d = _dealt(_docs(items, "doc_id"))
    if d.unique:
        return S.term_freq(d.docs, ["doc_id"]).filter("batch IS NOT NULL AND pos IS NOT NULL").select("doc_id", "term", "tf")
    tf = S.term_freq(d.docs)
    return tf.join(items.select("batch", "pos", "doc_id"), ["batch", "pos"]).select("doc_id", "term", "tf")


@register("doc_freq", f"""
WITH {_ITEMS}, {Q.tfidf_ctes('items')}
SELECT batch, term, df, total FROM _dfs""")
def q_doc_freq(spark, sf):
    d = _dealt(_docs(_doc_items(spark, sf)))
    return S.doc_freq(S.term_freq(d.docs)).select("batch", "term", "df", "total")


@register("vocab_top_k", f"""
WITH {_ITEMS}, {Q.tfidf_ctes('items')}
SELECT batch, term, total, vr AS vrank FROM _vocab""")
def q_vocab_top_k(spark, sf):
    d = _dealt(_docs(_doc_items(spark, sf)))
    return S.vocabulary(S.doc_freq(S.term_freq(d.docs)), whole=d.whole).select("batch", "term", "total", "vrank")


@register("idf", f"""
WITH {_ITEMS}, {Q.tfidf_ctes('items')}
SELECT v.batch, v.term, round(ln((1.0 + n.n) / (1.0 + v.df)) + 1.0, 9) AS idf
FROM _vocab v JOIN _nv n ON n.batch = v.batch""")
def q_idf(spark, sf):
    d = _dealt(_docs(_doc_items(spark, sf)))
    v = S.idf(S.vocabulary(S.doc_freq(S.term_freq(d.docs)), whole=d.whole), S.valid_counts(d.docs))
    return v.select("batch", "term", F.round("idf", 9).alias("idf"))


@register("tfidf", f"""
WITH {_ITEMS}, {Q.tfidf_ctes('items')}
SELECT i.doc_id, w.term, round(w.wt, 6) AS weight FROM wts w JOIN items i ON i.batch = w.batch AND i.pos = w.pos""")
def q_tfidf(spark, sf):
    items = _doc_items(spark, sf)
    d = _dealt(_docs(items))
    # dealt alike, so the weights are joined in their tasks
    ids = items.select("batch", "pos", "doc_id")
    return S.tfidf(d.docs, d=d).join(d.deal(ids) if d.whole else ids, ["batch", "pos"]) \
        .select("doc_id", "term", F.round("weight", 6).alias("weight"))


@register("similar_pairs", f"""
WITH {_ITEMS}, {Q.tfidf_ctes('items')}, {Q.pairs_cte(THRESHOLD)}
SELECT p.batch, a.doc_id AS doc_i, b.doc_id AS doc_j, round(p.sim, 6) AS sim
FROM pairs p JOIN items a ON a.batch = p.batch AND a.pos = p.i JOIN items b ON b.batch = p.batch AND b.pos = p.j""")
def q_similar_pairs(spark, sf):
    items = _doc_items(spark, sf)
    d = _dealt(_docs(items))
    packed = d.whole and d.rows <= D.BLOCK_ROWS
    pairs = S.similar_pairs(S.tfidf(d.docs, names=False, d=d, packed=packed), THRESHOLD, d=d)
    ids = items.select("batch", "pos", "doc_id")
    return (pairs.join(ids.withColumnRenamed("pos", "i").withColumnRenamed("doc_id", "doc_i"), ["batch", "i"])
            .join(ids.withColumnRenamed("pos", "j").withColumnRenamed("doc_id", "doc_j"), ["batch", "j"])
            .select("batch", "doc_i", "doc_j", F.round("sim", 6).alias("sim")))


# ---------------------------------------------------------------------------
# Duplicate removal: H9-H12
# ---------------------------------------------------------------------------
@register("dedup_batch", f"""
WITH RECURSIVE {_ITEMS}, {Q.tfidf_ctes('items')}, {Q.pairs_cte(THRESHOLD)}, {Q.greedy_ctes()}
SELECT i.doc_id, i.batch, (g.pos IS NULL) AS keep
FROM items i LEFT JOIN gone g ON g.batch = i.batch AND g.pos = i.pos""")
def q_dedup_batch(spark, sf):
    items = _doc_items(spark, sf)
    flags = D.dedup_flags(_docs(items), THRESHOLD)
    return flags.join(items.select("batch", "pos", "doc_id"), ["batch", "pos"]) \
        .select("doc_id", "batch", "keep")


_CORPUS_ITEMS = f"""
items AS (SELECT doc_id, 'all' AS batch, doc_id AS pos, {Q.corpus('NULL', 'text')} AS norm FROM documents)"""


@register("dedup_corpus", f"""
WITH RECURSIVE {_CORPUS_ITEMS}, {Q.tfidf_ctes('items', None)}, {Q.pairs_cte(THRESHOLD)}, {Q.greedy_ctes()}
SELECT i.doc_id, (g.pos IS NULL) AS keep
FROM items i LEFT JOIN gone g ON g.batch = i.batch AND g.pos = i.pos""")
def q_dedup_corpus(spark, sf):
    d = TB.table(spark, sf, "documents")
    docs = d.select(F.lit("all").alias("batch"), F.col("doc_id").alias("pos"),
                    T.corpus_text(F.lit(None).cast("string"), F.col("text")).alias("norm"))
    # the cap on terms belongs to batches of pending rows; a corpus uses all its terms
    return D.dedup_flags(docs, THRESHOLD, max_features=None).select(F.col("pos").alias("doc_id"), "keep")


@register("similar_pairs_lsh", None)
def q_similar_pairs_lsh(spark, sf):
    """Pairs of the whole corpus with candidates from hyperplane signatures (H11's opt-in form): no
    exact SQL form, as some pairs are missed; tests hold it against the exact pairs."""
    d = TB.table(spark, sf, "documents")
    docs = d.select(F.lit("all").alias("batch"), F.col("doc_id").alias("pos"),
                    T.corpus_text(F.lit(None).cast("string"), F.col("text")).alias("norm"))
    docs = stored(docs)
    d = S.dealt(docs)
    if d.unique:
        pairs = S.similar_pairs_signed(S.shared_rows(D.distinct_texts(docs), d.chars, THRESHOLD, signed=True), THRESHOLD)
    else:
        reps = cut_lineage(D.first_copies(docs).filter(F.col("pos") == F.col("rep")).select("batch", "pos"))
        pairs = S.similar_pairs_lsh(cut_lineage(S.tfidf(docs, None, d=d).join(reps, ["batch", "pos"], "left_semi")), THRESHOLD)
    return pairs.select(F.col("i").alias("doc_i"), F.col("j").alias("doc_j"), F.round("sim", 6).alias("sim"))


@register("dedup_report", f"""
WITH RECURSIVE {_ITEMS}, {Q.tfidf_ctes('items')}, {Q.pairs_cte(THRESHOLD)}, {Q.greedy_ctes()},
_by AS (SELECT p.batch, p.j, min({{'i': p.i, 's': p.sim}}) AS m FROM pairs p
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.batch = p.batch AND g.pos = p.i) GROUP BY p.batch, p.j)
SELECT a.doc_id AS doc_id, b.doc_id AS kept_by, round(_by.m.s, 6) AS sim
FROM _by JOIN items a ON a.batch = _by.batch AND a.pos = _by.j
         JOIN items b ON b.batch = _by.batch AND b.pos = _by.m.i""")
def q_dedup_report(spark, sf):
    items = _doc_items(spark, sf)
    _, report = D.dedup_flags(_docs(items), THRESHOLD, with_report=True)
    ids = items.select("batch", "pos", "doc_id")
    return (report.join(ids, ["batch", "pos"])
            .join(ids.select("batch", F.col("pos").alias("kept_by"), F.col("doc_id").alias("kept_doc")),
                  ["batch", "kept_by"])
            .select("doc_id", F.col("kept_doc").alias("kept_by"), F.round("sim", 6).alias("sim")))


# ---------------------------------------------------------------------------
# Extraction: A2-A7, B4-B11, B20, E1-E3
# ---------------------------------------------------------------------------
from wirefold.sources import extract as X  # noqa: E402
from wirefold.sources import landing as L  # noqa: E402

_ITEM_COLS = ", ".join(X.ITEM_COLUMNS)
_PAGES_ALL = "SELECT page_id AS source_id, url AS page_url, html AS body FROM pages"
_PAGES_OK = _PAGES_ALL + " WHERE contains(html, '</html>')"


def _pages(spark, sf):
    return TB.table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), "url",
                                               F.col("html").alias("body"))


@register("landed_ok", "SELECT page_id, url FROM pages WHERE contains(html, '</html>')")
def q_landed_ok(spark, sf):
    return X.landed_ok(L.web_pages(spark, sf)).select(F.col("source_id").alias("page_id"), "url")


@register("page_links", f"WITH {Q.anchors_ctes(_PAGES_ALL)}, {Q.page_links_ctes(15)} SELECT {_ITEM_COLS} FROM links")
def q_page_links(spark, sf):
    return X.page_links(_pages(spark, sf), min_title=15)


@register("page_links_min5", f"WITH {Q.anchors_ctes(_PAGES_ALL)}, {Q.page_links_ctes(5)} SELECT {_ITEM_COLS} FROM links")
def q_page_links_min5(spark, sf):
    return X.page_links(_pages(spark, sf), min_title=5)


@register("first_per_key", f"""
WITH {Q.anchors_ctes(_PAGES_ALL)},
_r AS (SELECT source_id, pos, {Q.resolve('href', 'page_url')} AS link FROM anchors)
SELECT source_id AS page_id, link, min(pos) AS first_pos, count(*) AS n_seen FROM _r GROUP BY source_id, link""")
def q_first_per_key(spark, sf):
    a = X.anchors(_pages(spark, sf)).withColumn("link", T.resolve_link(F.col("href"), F.col("page_url")))
    return a.groupBy(F.col("source_id").alias("page_id"), "link").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_seen"))


@register("resolve_links", f"""
WITH {Q.anchors_ctes(_PAGES_ALL)}
SELECT source_id AS page_id, pos, href, {Q.resolve('href', 'page_url')} AS link FROM anchors""")
def q_resolve_links(spark, sf):
    a = X.anchors(_pages(spark, sf))
    return a.select(F.col("source_id").alias("page_id"), "pos", "href",
                    T.resolve_link(F.col("href"), F.col("page_url")).alias("link"))


_KW_PAGES = ["the", "/und"]


@register("keyword_flag", f"""
WITH {Q.anchors_ctes(_PAGES_ALL)}
SELECT source_id AS page_id, pos, {Q.keyword_flag(Q.resolve('href', 'page_url'), 'text', _KW_PAGES)} AS flag
FROM anchors""")
def q_keyword_flag(spark, sf):
    a = X.anchors(_pages(spark, sf))
    return a.select(F.col("source_id").alias("page_id"), "pos",
                    T.keyword_flag(T.resolve_link(F.col("href"), F.col("page_url")), F.col("text"),
                                   _KW_PAGES).alias("flag"))


@register("html_to_text", f"SELECT page_id, {Q.clean(Q.html_to_text('html'), 1_000_000_000)} AS text FROM pages")
def q_html_to_text(spark, sf):
    p = TB.table(spark, sf, "pages")
    return p.select("page_id", T.clean_text(M.html_to_text(F.col("html")), 1_000_000_000).alias("text"))


@register("rewrite_path", f"""
WITH {Q.anchors_ctes(_PAGES_ALL)}
SELECT source_id AS page_id, pos, {Q.rewrite_path('href')} AS url FROM anchors""")
def q_rewrite_path(spark, sf):
    a = X.anchors(_pages(spark, sf))
    return a.select(F.col("source_id").alias("page_id"), "pos", T.rewrite_path(F.col("href")).alias("url"))


@register("truncate_title", f"""
SELECT conv_id, turn, {Q.truncate_title(Q.clean('text'))} AS title FROM conversations""")
def q_truncate_title(spark, sf):
    c = TB.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.truncate_title(T.clean_text(F.col("text"))).alias("title"))


@register("strip_handle", f"""
WITH {_SOURCES_SQL}
SELECT id, regexp_replace('@@' || lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')), '^@+', '') AS handle
FROM _src WHERE source_type = 'x'""")
def q_strip_handle(spark, sf):
    s = TB.sources_small(spark, sf).filter(F.col("source_type") == "x")
    return s.select("id", T.strip_handle(F.concat(F.lit("@"), F.col("x_handle"))).alias("handle"))


@register("first_nonempty", f"""
SELECT d.doc_id, {Q.first_nonempty("CASE WHEN l.quality = 1 THEN 'good' ELSE '' END", 'd.lang', 'd.text')} AS body
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_first_nonempty(spark, sf):
    d = TB.table(spark, sf, "documents")
    lab = TB.table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    summary = F.when(F.col("quality") == 1, F.lit("good")).otherwise(F.lit(""))
    return j.select("doc_id", T.first_nonempty(summary, F.col("lang"), F.col("text")).alias("body"))


@register("feed_items", f"WITH {Q.feed_items_ctes()} SELECT {_ITEM_COLS} FROM feed_items")
def q_feed_items(spark, sf):
    return X.feed_items(L.feeds(spark, sf))


@register("timeline_posts", f"WITH {Q.timeline_posts_ctes()} SELECT {_ITEM_COLS} FROM posts")
def q_timeline_posts(spark, sf):
    return X.timeline_posts(L.timelines(spark, sf))


@register("first_n_before", """
WITH _c AS (SELECT 2000000000 + conv_id * 1000000 + turn // 20 AS source_id, role,
                   row_number() OVER (PARTITION BY conv_id, turn // 20 ORDER BY turn) - 1 AS pos FROM conversations)
SELECT source_id, count(*) AS n_considered, count(*) FILTER (WHERE role <> 'system') AS n_with_link
FROM _c WHERE pos < 10 GROUP BY source_id""")
def q_first_n_before(spark, sf):
    b = X.timeline_blocks(L.timelines(spark, sf)).filter(F.col("pos") < X.POST_LIMIT)
    return b.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_considered"),
        F.count_if(F.size(X.post_links("parts")) > 0).alias("n_with_link"))


@register("mirror_failover", f"""
WITH {Q.anchors_ctes(_PAGES_ALL)}, {Q.page_links_ctes(5)},
_att AS (SELECT page_id AS source_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS handle,
                row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY page_id) - 1
                AS mirror_rank FROM pages),
_cnt AS (SELECT source_id, count(*) AS n_items FROM links GROUP BY source_id),
_good AS (SELECT a.handle, a.mirror_rank, a.source_id, c.n_items FROM _att a JOIN _cnt c ON c.source_id = a.source_id
          WHERE a.mirror_rank < 4 AND c.n_items > 0)
SELECT handle, min(mirror_rank) AS mirror_rank, arg_min(source_id, mirror_rank) AS source_id,
       arg_min(n_items, mirror_rank) AS n_items FROM _good GROUP BY handle""")
def q_mirror_failover(spark, sf):
    from pyspark.sql import Window
    p = _pages(spark, sf)
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    # the first mirrors of each host (each task cuts a host to those), then only their pages are parsed
    w = Window.partitionBy("handle").orderBy("source_id")
    att = cut_lineage(p.select("source_id", host.alias("handle")).withColumn("n", F.row_number().over(w))
                      .filter(F.col("n") <= T.MIRRORS)
                      .select("source_id", "handle", (F.col("n") - 1).alias("mirror_rank")))
    items = X.page_links(p.join(att.select("source_id"), "source_id", "left_semi"), min_title=5)
    return X.mirror_failover(items, att)


# sources that are active, of a known type and have what their type needs
_PAGES_LIVE = _PAGES_OK + " AND page_id % 11 <> 3 AND page_id % 17 <> 7 AND page_id % 13 <> 5 AND url <> ''"
_FETCH_SQL = (f"{Q.anchors_ctes(_PAGES_LIVE)}, {Q.page_links_ctes(15)}, {Q.feed_items_ctes(where='doc_id // 20 % 9 <> 4')}, "
              f"{Q.timeline_posts_ctes(where='conv_id % 7 <> 3')}")


@register("fetch_all_active", f"""
WITH {_FETCH_SQL}
SELECT {_ITEM_COLS} FROM feed_items UNION ALL SELECT {_ITEM_COLS} FROM links
UNION ALL SELECT {_ITEM_COLS} FROM posts""")
def q_fetch_all_active(spark, sf):
    sources, land = L.landing(spark, sf)
    return X.fetch_all_active(sources, land)


# ---------------------------------------------------------------------------
# Keyed state changes: I1-I9, A9, A10, C3
# ---------------------------------------------------------------------------
from wirefold.operators import state as ST  # noqa: E402

_LINK_STATE_SQL = f"""{Q.anchors_ctes(_PAGES_ALL)}, {Q.page_links_ctes(15, out='links15')}, {Q.page_links_ctes(5, out='links5').replace('_pl0', '_qq0').replace('_pl2', '_qq2').replace('_pl3', '_qq3')},
_st AS (SELECT url, source_id, pos, title FROM (
          SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_type, source_id, pos) AS r FROM links15) WHERE r = 1),
_new AS (SELECT url, source_id, pos, title FROM (
          SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_type, source_id, pos) AS r
          FROM links5 WHERE url IS NOT NULL) x
        WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM _st s WHERE s.url = x.url))"""


def _link_state(spark, sf):
    a = cut_lineage(X.anchors(_pages(spark, sf)))
    first = X.links_of(a, min_title=15)
    empty = first.limit(0).select("url", "source_id", "pos", "title")
    state = ST.apply_insert_or_ignore(empty, first.select("url", "source_id", "pos", "title", "source_type"),
                                      ["url"], ["source_type", "source_id", "pos"])
    changes = X.links_of(a, min_title=5).select("url", "source_id", "pos", "title", "source_type")
    return state, changes


@register("insert_or_ignore", f"""
WITH {_LINK_STATE_SQL}
SELECT url, source_id, pos, title FROM _st UNION ALL SELECT url, source_id, pos, title FROM _new""")
def q_insert_or_ignore(spark, sf):
    state, changes = _link_state(spark, sf)
    return ST.apply_insert_or_ignore(state, changes, ["url"], ["source_type", "source_id", "pos"])


_SLOT_SQL = """
_ev AS (SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute FROM events),
_seed AS (SELECT * FROM (VALUES (9, 0), (12, 0), (18, 0), (23, 0)) t(hour, minute)),
_firsts AS (SELECT hour, minute, min(event_id) AS event_id FROM _ev GROUP BY hour, minute)"""

DEFAULT_SLOTS = [(9, 0), (12, 0), (18, 0), (23, 0)]  # fixed default delivery times


def _seed_slots(spark):
    return spark.createDataFrame([(h, m) for h, m in DEFAULT_SLOTS], "hour int, minute int") \
        .withColumn("event_id", F.lit(None).cast("long"))


def _event_slots(spark, sf):
    ev = TB.table(spark, sf, "events")
    return ev.select("event_id", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"))


@register("insert_or_ignore_pair", f"""
WITH {_SLOT_SQL}
SELECT hour, minute, CAST(NULL AS BIGINT) AS event_id FROM _seed
UNION ALL
SELECT f.hour, f.minute, f.event_id FROM _firsts f
WHERE NOT EXISTS (SELECT 1 FROM _seed s WHERE s.hour = f.hour AND s.minute = f.minute)""")
def q_insert_or_ignore_pair(spark, sf):
    state = _seed_slots(spark)
    return ST.apply_insert_or_ignore(state, _event_slots(spark, sf), ["hour", "minute"], ["event_id"])


@register("seed_if_empty", f"""
WITH {_SLOT_SQL}
SELECT hour, minute, event_id FROM _firsts""")
def q_seed_if_empty(spark, sf):
    target = ST.first_per_key(_event_slots(spark, sf), ["hour", "minute"], ["event_id"]) \
        .select("hour", "minute", "event_id")
    return ST.seed_if_empty(target, _seed_slots(spark))


@register("seed_if_empty_target", f"""
WITH {_SLOT_SQL}
SELECT hour, minute, CAST(NULL AS BIGINT) AS event_id FROM _seed
WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'unheard of')""")
def q_seed_if_empty_target(spark, sf):
    none = TB.table(spark, sf, "events").filter(F.col("event_type") == "unheard of")
    target = none.select(F.hour("ts").alias("hour"), F.minute("ts").alias("minute"), "event_id")
    return ST.seed_if_empty(target, _seed_slots(spark))


@register("upsert", """
WITH _st AS (SELECT user_id, false AS admin, max(ts) AS last_fetch_at FROM events
             WHERE event_type = 'signup' AND value > 10 GROUP BY user_id),
_ch AS (SELECT user_id, arg_max(ts, (ts, event_id)) AS ts FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT coalesce(s.user_id, c.user_id) AS user_id,
       CASE WHEN s.user_id IS NOT NULL THEN s.admin ELSE false END AS admin,
       CASE WHEN c.user_id IS NOT NULL THEN c.ts ELSE s.last_fetch_at END AS last_fetch_at
FROM _st s FULL OUTER JOIN _ch c ON c.user_id = s.user_id""")
def q_upsert(spark, sf):
    ev = TB.table(spark, sf, "events")
    state = (ev.filter((F.col("event_type") == "signup") & (F.col("value") > 10))
             .groupBy("user_id").agg(F.lit(False).alias("admin"), F.max("ts").alias("last_fetch_at")))
    changes = ev.filter(F.col("event_type") == "click").select(
        "user_id", "event_id", "ts", F.col("ts").alias("last_fetch_at"))
    return ST.upsert(state, changes, ["user_id"], ["last_fetch_at"], ["ts", "event_id"],
                     defaults={"admin": F.lit(False)})


@register("update_by_key", f"""
WITH {_SOURCES_SQL}
SELECT s.id, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_acctbal >= 0 ELSE s.active END AS active,
       c.c_custkey IS NOT NULL AS updated
FROM _src s LEFT JOIN customer c ON c.c_custkey = s.id""")
def q_update_by_key(spark, sf):
    state = TB.sources_small(spark, sf).select("id", "active")
    changes = TB.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                                     (F.col("c_acctbal") >= 0).alias("active"))
    return ST.update_by_key(state, changes, ["id"], ["active"])


@register("delete_cascade", """
WITH _gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE'),
_s AS (SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM _gone)),
_n AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM _gone)),
_l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN
        (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM _gone)))
SELECT 'sources' AS tbl, c_custkey AS id, NULL::BIGINT AS parent FROM _s
UNION ALL SELECT 'news', o_orderkey, o_custkey FROM _n
UNION ALL SELECT 'sent', l_linenumber, l_orderkey FROM _l""")
def q_delete_cascade(spark, sf):
    cust = TB.table(spark, sf, "customer")
    orders = TB.table(spark, sf, "orders")
    items = TB.table(spark, sf, "lineitem")
    doomed = cust.filter(F.col("c_mktsegment") == "AUTOMOBILE").select("c_custkey")
    s, n, li = ST.delete_cascade([(cust, "c_custkey", ""), (orders, "o_orderkey", "o_custkey"),
                                  (items, "l_linenumber", "l_orderkey")], doomed, "c_custkey")
    rows = lambda df, tbl, key, parent: df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("long").alias("id"),
                                                  parent.cast("long").alias("parent"))
    return (rows(s, "sources", "c_custkey", F.lit(None)).unionByName(rows(n, "news", "o_orderkey", F.col("o_custkey")))
            .unionByName(rows(li, "sent", "l_linenumber", F.col("l_orderkey"))))


@register("fk_accept", """
SELECT o_orderkey AS id, o_custkey AS source_id FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'AUTOMOBILE')""")
def q_fk_accept(spark, sf):
    parent = TB.table(spark, sf, "customer").filter(F.col("c_mktsegment") != "AUTOMOBILE")
    ok, _ = ST.fk_split(TB.news_orders(spark, sf), parent, "source_id", "c_custkey")
    return ok.select("id", "source_id")


@register("fk_reject", """
SELECT o_orderkey AS id, o_custkey AS source_id FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'AUTOMOBILE')""")
def q_fk_reject(spark, sf):
    parent = TB.table(spark, sf, "customer").filter(F.col("c_mktsegment") != "AUTOMOBILE")
    _, bad = ST.fk_split(TB.news_orders(spark, sf), parent, "source_id", "c_custkey")
    return bad.select("id", "source_id")


_CAND_SQL = """
_cand AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END AS name,
                 ['rss', 'web', 'x', 'atom'][(s_suppkey % 4) + 1] AS source_type FROM supplier),
_val AS (SELECT *, CASE WHEN name IS NULL THEN 'name_null'
                        WHEN source_type NOT IN ('web', 'rss', 'x') THEN 'bad_type' END AS reason FROM _cand)"""


def _candidates(spark, sf):
    s = TB.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"),
                    F.when(F.col("s_acctbal") < 0, F.lit(None)).otherwise(F.col("s_name")).alias("name"),
                    F.element_at(F.array(*[F.lit(t) for t in ["rss", "web", "x", "atom"]]),
                                 (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int")).alias("source_type"))


def _source_rules():
    return [("name_null", F.col("name").isNotNull()),
            ("bad_type", F.col("source_type").isin(*TB.SOURCE_TYPES))]


@register("validate_rows", f"""
WITH {_CAND_SQL}
SELECT id, reason IS NULL AS accepted, reason FROM _val""")
def q_validate_rows(spark, sf):
    return ST.validate(_candidates(spark, sf), _source_rules()).select("id", "accepted", "reason")


@register("add_source", f"""
WITH {_SOURCES_SQL}, {_CAND_SQL}
SELECT id, name, source_type FROM _src
UNION ALL
SELECT (SELECT max(id) FROM _src) + row_number() OVER (ORDER BY id) AS id, name, source_type
FROM _val WHERE reason IS NULL""")
def q_add_source(spark, sf):
    state = TB.sources_small(spark, sf).select("id", "name", "source_type")
    ok = ST.validate(_candidates(spark, sf), _source_rules()).filter("accepted")
    new = ST.assign_ids(ok.select(F.col("id").alias("arrival"), "name", "source_type"), ["arrival"],
                        state.agg(F.max("id")).scalar())
    return state.unionByName(new.select("id", "name", "source_type"))


@register("assign_ids", """
SELECT c_custkey, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey) AS new_id
FROM customer""")
def q_assign_ids(spark, sf):
    cust = TB.table(spark, sf, "customer").select("c_custkey")
    base = TB.table(spark, sf, "supplier").agg(F.max("s_suppkey")).scalar()
    return ST.assign_ids(cust, ["c_custkey"], base, out="new_id")


ADMIN_OVERRIDE = [1, 2, 3]  # fixed id list that is always admin (configuration)


@register("flag_by_key", f"""
WITH _u AS (SELECT DISTINCT user_id FROM events),
_f AS (SELECT user_id, count(*) >= 15 AS admin FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT u.user_id, coalesce(f.admin, false) OR u.user_id IN ({', '.join(map(str, ADMIN_OVERRIDE))}) AS is_admin
FROM _u u LEFT JOIN _f f ON f.user_id = u.user_id""")
def q_flag_by_key(spark, sf):
    ev = TB.table(spark, sf, "events")
    users = ev.select("user_id").distinct()
    flags = ev.filter(F.col("event_type") == "purchase").groupBy("user_id") \
        .agg((F.count(F.lit(1)) >= 15).alias("admin"))
    return ST.flag_by_key(users, flags, "user_id", "admin", ADMIN_OVERRIDE, out="is_admin")


@register("mark_sent", f"""
WITH {_NEWS_SQL},
_top AS (SELECT id FROM _n WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = _n.id AND l.l_returnflag = '{CHAT}')
         ORDER BY fetched_at DESC, id DESC LIMIT 50),
_log AS (SELECT l_orderkey AS news_id, l_returnflag AS sent_to_chat_id FROM lineitem UNION ALL SELECT id, '{CHAT}' FROM _top)
SELECT news_id, sent_to_chat_id FROM _log""")
def q_mark_sent(spark, sf):
    sent = TB.sent_lineitem(spark, sf)
    top = SEL.unsent_news(TB.news_orders(spark, sf), TB.sources_large(spark, sf), sent, CHAT)
    return ST.append_rows(sent, top.select(F.col("id").alias("news_id"), F.lit(CHAT).alias("sent_to_chat_id")))


# ---------------------------------------------------------------------------
# Reports and rendering: B13-B17, B19, D2, D3, F4
# ---------------------------------------------------------------------------
from wirefold.operators import enrich as EN  # noqa: E402
from wirefold.operators import report as RP  # noqa: E402


def _slots(spark, sf):
    """Slots from events: first event per (hour, minute); active unless that
    first event is an error."""
    ev = TB.table(spark, sf, "events").select("event_id", "event_type", F.hour("ts").alias("hour"),
                                              F.minute("ts").alias("minute"))
    first = ST.first_per_key(ev, ["hour", "minute"], ["event_id"])
    return first.select(F.col("event_id").alias("id"), "hour", "minute",
                        (F.col("event_type") != "error").alias("active"))


_SLOTS_SQL = """
_sl AS (SELECT arg_min(event_id, event_id) AS id, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute,
               arg_min(event_type, event_id) <> 'error' AS active
        FROM events GROUP BY hour(ts), minute(ts))"""


@register("list_slots", f"WITH {_SLOTS_SQL} SELECT id, hour, minute, active FROM _sl WHERE active ORDER BY hour, minute")
def q_list_slots(spark, sf):
    return SEL.list_slots(_slots(spark, sf), only_active=True).select("id", "hour", "minute", "active")


@register("format_slot", f"WITH {_SLOTS_SQL} SELECT id, printf('%02d:%02d', hour, minute) AS slot FROM _sl")
def q_format_slot(spark, sf):
    return _slots(spark, sf).select("id", T.format_slot(F.col("hour"), F.col("minute")).alias("slot"))


_SLOT_TEXT = ("CASE WHEN event_type = 'error' THEN props ELSE CAST(hour(ts) AS VARCHAR) || ':' || "
              "CAST(minute(ts) AS VARCHAR) END")


@register("parse_slot", f"""
WITH _t AS (SELECT event_id, {_SLOT_TEXT} AS txt FROM events),
_p AS (SELECT event_id, string_split(txt, ':') AS parts FROM _t),
_v AS (SELECT event_id, CASE WHEN len(parts) = 2 THEN TRY_CAST(trim(parts[1]) AS INTEGER) END AS hour,
              CASE WHEN len(parts) = 2 THEN TRY_CAST(trim(parts[2]) AS INTEGER) END AS minute FROM _p),
_w AS (SELECT event_id, CASE WHEN hour IS NOT NULL AND minute IS NOT NULL THEN hour END AS hour,
              CASE WHEN hour IS NOT NULL AND minute IS NOT NULL THEN minute END AS minute FROM _v)
SELECT event_id, hour, minute, coalesce(hour BETWEEN 0 AND 23 AND minute BETWEEN 0 AND 59, false) AS accepted FROM _w""")
def q_parse_slot(spark, sf):
    ev = TB.table(spark, sf, "events")
    txt = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.concat(F.hour("ts").cast("string"), F.lit(":"), F.minute("ts").cast("string")))
    p = ev.select("event_id", T.parse_slot(txt).alias("p"))
    ok = F.col("p.hour").between(0, 23) & F.col("p.minute").between(0, 59)
    return p.select("event_id", F.col("p.hour").alias("hour"), F.col("p.minute").alias("minute"),
                    F.coalesce(ok, F.lit(False)).alias("accepted"))


@register("status_report", f"""
WITH {_SOURCES_SQL}, {_SLOTS_SQL}
SELECT (SELECT count(*) FROM _src) AS n_sources, (SELECT count(*) FILTER (WHERE active) FROM _src) AS n_active_sources,
       (SELECT count(*) FILTER (WHERE active) FROM _sl) AS n_active_slots,
       (SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS n_recent""")
def q_status_report(spark, sf):
    ev = TB.table(spark, sf, "events")
    now = ev.agg(F.max("ts")).scalar()
    return SEL.status_report(TB.sources_small(spark, sf), _slots(spark, sf), ev, now, 24, ts_col="ts")


_SRC_LINE_SQL = f"""
_srcx AS (SELECT s_suppkey AS id, s_name AS name, ['rss', 'web', 'x'][(s_suppkey % 3) + 1] AS source_type,
                 (s_suppkey % 5) <> 0 AS active FROM supplier),
_srcy AS (SELECT *, CASE WHEN source_type <> 'x' THEN 'https://feeds.example.org/' || CAST(id AS VARCHAR) END AS url,
                 CASE WHEN source_type = 'x' THEN '@' || lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) END AS x_handle
          FROM _srcx),
_lines AS (SELECT source_type, id, CASE WHEN active THEN {Q.q(T.STATUS_ON)} ELSE {Q.q(T.STATUS_OFF)} END || ' <code>' ||
                  CAST(id AS VARCHAR) || '</code> [' || source_type || '] <b>' || name || '</b> — ' ||
                  coalesce(nullif(url, ''), '@' || coalesce(x_handle, '')) AS line FROM _srcy),
_txt AS (SELECT {Q.q(RP.SOURCES_HEADER)} || chr(10) || string_agg(line, chr(10) ORDER BY source_type, id) AS t FROM _lines)"""


@register("source_report", f"""
WITH {_SRC_LINE_SQL}
SELECT g AS piece_no, substring(t, CAST(g * 3800 + 1 AS BIGINT), 3800) AS piece
FROM _txt, unnest(generate_series(0, (length(t) - 1) // 3800)) AS u(g)""")
def q_source_report(spark, sf):
    lines = RP.source_lines(TB.sources_small(spark, sf))
    return RP.chunked_report(lines, ["source_type", "id"], RP.SOURCES_HEADER).select("piece_no", "piece")


@register("chunk_text", """
SELECT doc_id, g AS piece_no, substring(text, CAST(g * 3800 + 1 AS BIGINT), 3800) AS piece
FROM documents, unnest(generate_series(0, (length(text) - 1) // 3800)) AS u(g) WHERE length(text) > 0""")
def q_chunk_text(spark, sf):
    d = TB.table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(T.chunk_pieces(F.col("text"))).alias("piece_no", "piece"))


_RENDER_ITEMS_SQL = """
_ri AS (SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title,
               CASE WHEN l.quality = 1 THEN 'good <summary>' WHEN l.quality = 0 THEN '' END AS summary_tr,
               d.text AS content, d.source AS source_name,
               'https://' || d.source || '.example.org/doc/' || CAST(d.doc_id AS VARCHAR) AS url,
               l.toxic = 1 AS is_column
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _render_items(spark, sf):
    d = TB.table(spark, sf, "documents")
    lab = TB.table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        "doc_id", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.when(F.col("quality") == 1, F.lit("good <summary>")).when(F.col("quality") == 0, F.lit(""))
        .alias("summary_tr"),
        F.col("text").alias("content"), F.col("source").alias("source_name"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/doc/"), F.col("doc_id").cast("string"))
        .alias("url"), (F.col("toxic") == 1).alias("is_column"))


@register("render_message", f"""
WITH {_RENDER_ITEMS_SQL}
SELECT doc_id, {Q.render('title', 'summary_tr', 'content', 'source_name', 'url', 'is_column')} AS message FROM _ri""")
def q_render_message(spark, sf):
    r = _render_items(spark, sf)
    return r.select("doc_id", T.render_message(F.col("title"), F.col("summary_tr"), F.col("content"),
                                               F.col("source_name"), F.col("url"), F.col("is_column"))
                    .alias("message"))


# ---------------------------------------------------------------------------
# Enrichment: E5, K1, C4
# ---------------------------------------------------------------------------
_UNSUM_SQL = """
_us AS (SELECT d.doc_id, d.source, d.text,
               (row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1) // 6 AS batch_no
        FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))"""


def _unsummarised(spark, sf):
    d = TB.table(spark, sf, "documents")
    lab = TB.table(spark, sf, "labels")
    rows = d.join(lab.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "text")
    return EN.summary_batches(rows, ["source"], ["doc_id"])


@register("summary_batches", f"WITH {_UNSUM_SQL} SELECT doc_id, source, batch_no FROM _us")
def q_summary_batches(spark, sf):
    return _unsummarised(spark, sf).select("doc_id", "source", "batch_no")


_FIRST_SENTENCE = Q.ws_trim("regexp_extract(coalesce(text, ''), '^([^.]*\\.?)', 1)")


@register("enrich_batches", f"""
WITH {_UNSUM_SQL}
SELECT doc_id AS id, {_FIRST_SENTENCE} AS summary FROM _us""")
def q_enrich_batches(spark, sf):
    rows = _unsummarised(spark, sf).select(F.col("doc_id").alias("id"), "source", "batch_no",
                                           F.col("text").alias("content"))
    return EN.enrich_batches(rows, EN.first_sentence_summaries, ["source", "batch_no"])


@register("apply_summaries", f"""
WITH {_UNSUM_SQL},
_new AS (SELECT doc_id AS id, {_FIRST_SENTENCE} AS summary FROM _us)
SELECT d.doc_id, coalesce(n.summary, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || CAST(l.quality AS VARCHAR) END) AS summary_tr
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN _new n ON n.id = d.doc_id""")
def q_apply_summaries(spark, sf):
    d = TB.table(spark, sf, "documents")
    lab = TB.table(spark, sf, "labels")
    pending = d.join(lab, "doc_id", "left").select(
        "doc_id", F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string")))
        .alias("summary_tr"))
    rows = _unsummarised(spark, sf).select(F.col("doc_id").alias("id"), "source", "batch_no",
                                           F.col("text").alias("content"))
    new = EN.enrich_batches(rows, EN.first_sentence_summaries, ["source", "batch_no"])
    return EN.apply_summaries(pending, new, id_col="doc_id").select("doc_id", "summary_tr")


# ---------------------------------------------------------------------------
# Delivery cycle: J2-J5, D7 (flagship: news_cycle)
# ---------------------------------------------------------------------------
import re as _re  # noqa: E402

from wirefold.plans import cycle as CY  # noqa: E402

_BASE_TS = "2024-01-01 00:00:00"


def _prior_news(spark, sf):
    d = TB.table(spark, sf, "documents")
    return d.select(
        (F.col("doc_id") + 1).alias("id"),
        (F.floor(F.col("doc_id") / L.FEED_SIZE) + L.RSS_ID_BASE).cast("long").alias("source_id"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/doc/"), F.col("doc_id").cast("string"))
        .alias("url"),
        F.lit(None).cast("string").alias("published_at"),
        (F.lit(_BASE_TS).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)")))
        .alias("fetched_at"),
        F.lit(None).cast("string").alias("summary_tr"), F.lit(False).alias("is_column"))


def _prior_sent(spark, sf):
    lab = TB.table(spark, sf, "labels")
    return lab.filter(F.col("toxic") == 1).select(
        (F.col("doc_id") + 1).alias("news_id"), F.lit(CHAT).alias("sent_to_chat_id"),
        F.lit(None).cast("long").alias("message_id"))


def _cycle_inputs(spark, sf):
    sources, land = L.landing(spark, sf)
    ev = TB.table(spark, sf, "events")
    now = ev.agg(F.max("ts")).scalar()
    chats = SEL.chats_of(TB.sent_lineitem(spark, sf))
    return sources, land, _prior_news(spark, sf), _prior_sent(spark, sf), chats, now


_CYCLE_BASE_SQL = f"""{_FETCH_SQL},
_items AS (SELECT {_ITEM_COLS} FROM feed_items UNION ALL SELECT {_ITEM_COLS} FROM links
           UNION ALL SELECT {_ITEM_COLS} FROM posts),
_prior AS (SELECT doc_id + 1 AS id, doc_id // 20 + 1000000000 AS source_id, split_part(text, chr(10), 1) AS title,
                  text AS content, 'https://' || source || '.example.org/doc/' || CAST(doc_id AS VARCHAR) AS url,
                  NULL::VARCHAR AS published_at, TIMESTAMP '{_BASE_TS}' + to_seconds(doc_id) AS fetched_at,
                  NULL::VARCHAR AS summary_tr, false AS is_column FROM documents),
_srcs AS (SELECT page_id AS id, 'page-' || CAST(page_id AS VARCHAR) AS name FROM pages
          UNION ALL SELECT DISTINCT doc_id // 20 + 1000000000, 'feed-' || CAST(doc_id // 20 AS VARCHAR) FROM documents
          UNION ALL SELECT DISTINCT 2000000000 + conv_id * 1000000 + turn // 20, '@u' || CAST(conv_id AS VARCHAR)
                    FROM conversations),
_firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_type, source_id, pos) AS r
                           FROM _items WHERE url IS NOT NULL) WHERE r = 1),
_fresh AS (SELECT * FROM _firsts f WHERE NOT EXISTS (SELECT 1 FROM _prior p WHERE p.url = f.url)),
_new AS (SELECT (SELECT max(id) FROM _prior) + row_number() OVER (ORDER BY source_type, source_id, pos) AS id,
                source_id, title, content, url, published_at, (SELECT max(ts) FROM events) AS fetched_at,
                NULL::VARCHAR AS summary_tr, is_column FROM _fresh),
_news AS (SELECT * FROM _prior UNION ALL SELECT * FROM _new),
_sent0 AS (SELECT doc_id + 1 AS news_id, '{CHAT}' AS chat FROM labels WHERE toxic = 1),
_chats AS (SELECT DISTINCT l_returnflag AS chat_id FROM lineitem)"""

_DEDUP_NAMES = r"\b(items|_toks|_tf|_dfs|_vocab|_nv|_w0|wts|pairs|_tgt|_last|_walk|gone)\b"


def _cycle_sql(p: str, sent: str) -> str:
    """CTEs of one cycle over ``_news`` with sent log ``sent``; ends in ``{p}out``."""
    pend = f"""
{p}pend AS (SELECT * FROM (
    SELECT ch.chat_id, n.*, s.name AS source_name,
           row_number() OVER (PARTITION BY ch.chat_id ORDER BY n.fetched_at DESC, n.id DESC) AS "rank"
    FROM _chats ch JOIN _news n ON true JOIN _srcs s ON s.id = n.source_id
    WHERE NOT EXISTS (SELECT 1 FROM {sent} x WHERE x.news_id = n.id AND x.chat = ch.chat_id)) WHERE "rank" <= 50)"""
    dd = f"""
items AS (SELECT chat_id AS batch, "rank" AS pos, {Q.corpus('title', 'content')} AS norm FROM {p}pend),
{Q.tfidf_ctes('items')}, {Q.pairs_cte(THRESHOLD)}, {Q.greedy_ctes()}"""
    dd = _re.sub(_DEDUP_NAMES, lambda m: p + m.group(1), dd)
    first_sentence = Q.ws_trim("regexp_extract(coalesce(content, ''), '^([^.]*\\.?)', 1)")
    out = f"""
{p}kept AS (SELECT k.*, CASE WHEN coalesce(k.summary_tr, '') = '' THEN {first_sentence} ELSE k.summary_tr END AS summ
            FROM {p}pend k WHERE NOT EXISTS (SELECT 1 FROM {p}gone g WHERE g.batch = k.chat_id AND g.pos = k."rank")),
{p}out AS (SELECT chat_id, "rank", id AS news_id,
                  {Q.render('title', 'summ', 'content', 'source_name', 'url', 'is_column')} AS message FROM {p}kept)"""
    return pend + "," + dd + "," + out


@register("news_cycle", f"""
WITH RECURSIVE {_CYCLE_BASE_SQL}, {_cycle_sql('c1_', '_sent0')}
SELECT chat_id, "rank", news_id, message FROM c1_out""")
def q_news_cycle(spark, sf):
    sources, land, news, sent, chats, now = _cycle_inputs(spark, sf)
    r = CY.news_cycle(sources, land, news, sent, chats, now)
    return r["outbox"].select("chat_id", "rank", "news_id", "message")


@register("two_cycles", f"""
WITH RECURSIVE {_CYCLE_BASE_SQL}, {_cycle_sql('c1_', '_sent0')},
_sent1 AS (SELECT news_id, chat FROM _sent0 UNION ALL SELECT news_id, chat_id FROM c1_out),
{_cycle_sql('c2_', '_sent1')}
SELECT chat_id, "rank", news_id, message FROM c2_out""")
def q_two_cycles(spark, sf):
    sources, land, news, sent, chats, now = _cycle_inputs(spark, sf)
    r1 = CY.news_cycle(sources, land, news, sent, chats, now)
    results = r1["outbox"].select("news_id", "chat_id", F.lit(True).alias("ok"),
                                  F.lit(None).cast("long").alias("message_id"))
    sent1 = CY.delivery_log(sent, results)
    r2 = CY.news_cycle(sources, land, r1["news"], sent1, chats, now)
    return r2["outbox"].select("chat_id", "rank", "news_id", "message")


@register("cycle_news", f"""
WITH RECURSIVE {_CYCLE_BASE_SQL}, {_cycle_sql('c1_', '_sent0')},
_done AS (SELECT DISTINCT id, summ FROM c1_kept WHERE coalesce(summary_tr, '') = '')
SELECT n.id, n.source_id, n.url, n.title, coalesce(d.summ, n.summary_tr) AS summary_tr
FROM _news n LEFT JOIN _done d ON d.id = n.id""")
def q_cycle_news(spark, sf):
    """The news table after a cycle: added rows, and the summaries stored."""
    sources, land, news, sent, chats, now = _cycle_inputs(spark, sf)
    return CY.news_cycle(sources, land, news, sent, chats, now)["news"].select("id", "source_id", "url", "title", "summary_tr")


MAX_MESSAGE_CHARS = 4096  # message size limit of the delivery service


@register("delivery_log", f"""
WITH RECURSIVE {_CYCLE_BASE_SQL}, {_cycle_sql('c1_', '_sent0')},
_ok AS (SELECT DISTINCT news_id, chat_id FROM c1_out WHERE length(message) <= {MAX_MESSAGE_CHARS}),
_fresh_log AS (SELECT * FROM _ok o WHERE NOT EXISTS (SELECT 1 FROM _sent0 s WHERE s.news_id = o.news_id AND s.chat = o.chat_id))
SELECT news_id, chat AS sent_to_chat_id FROM _sent0 UNION ALL SELECT news_id, chat_id FROM _fresh_log""")
def q_delivery_log(spark, sf):
    sources, land, news, sent, chats, now = _cycle_inputs(spark, sf)
    out = CY.news_cycle(sources, land, news, sent, chats, now)["outbox"]
    results = out.select("news_id", "chat_id", (F.length("message") <= MAX_MESSAGE_CHARS).alias("ok"),
                         F.lit(None).cast("long").alias("message_id"))
    return CY.delivery_log(sent, results).select("news_id", "sent_to_chat_id")


@register("cycle_counts", f"""
WITH RECURSIVE {_CYCLE_BASE_SQL}, {_cycle_sql('c1_', '_sent0')},
_p AS (SELECT chat_id, count(*) AS n_pending FROM c1_pend GROUP BY chat_id),
_o AS (SELECT chat_id, count(*) AS n_sent FROM c1_out GROUP BY chat_id)
SELECT _p.chat_id, (SELECT count(*) FROM _new) AS n_added, n_pending, n_pending - coalesce(n_sent, 0) AS n_removed,
       coalesce(n_sent, 0) AS n_sent FROM _p LEFT JOIN _o ON _o.chat_id = _p.chat_id""")
def q_cycle_counts(spark, sf):
    sources, land, news, sent, chats, now = _cycle_inputs(spark, sf)
    r = CY.news_cycle(sources, land, news, sent, chats, now)
    return CY.cycle_counts(r["new_rows"], r["pending"], r["outbox"])


# ---------------------------------------------------------------------------
# Streaming ingest: J1
# ---------------------------------------------------------------------------
from wirefold.streaming import ingest as SI  # noqa: E402


STREAM_FILES = 3


@register("stream_ingest", """
SELECT user_id, event_id, ts FROM (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
WHERE r = 1""")
def q_stream_ingest(spark, sf):
    """Several micro-batches: the events lie in files by user, one file a batch."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = TB.table(spark, sf, "events").select("user_id", "ts", "event_id")
    events.repartition(STREAM_FILES, "user_id").write.parquet(f"{base}/source")
    path = SI.stream_ingest(spark, f"{base}/source", events.schema, ["user_id"], ["ts", "event_id"], base,
                            max_files_per_trigger=1)
    return spark.read.parquet(path).select("user_id", "event_id", "ts")


# ---------------------------------------------------------------------------
# Stored state: A8, A9, I1, I3, I5, J3, J4
# ---------------------------------------------------------------------------
from wirefold.operators import stored as SD  # noqa: E402
from wirefold.streaming import cycles as SC  # noqa: E402


def _stored_path(spark, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


@register("stored_insert", f"""
WITH {_LINK_STATE_SQL}
SELECT url, source_id, pos, title FROM _st UNION ALL SELECT url, source_id, pos, title FROM _new""")
def q_stored_insert(spark, sf):
    """Two written rounds of insert-or-ignore, the second one twice."""
    state, changes = _link_state(spark, sf)
    table = SD.KeyedTable(spark, _stored_path(spark, "stored-insert"), state.schema, ["url"], 16).create(state)
    for _ in range(2):
        table.insert_or_ignore(changes, ["url"], ["source_type", "source_id", "pos"])
    return table.read()


_ROUND = "abs(event_id) % 2"


@register("stored_upsert", f"""
WITH _st AS (SELECT user_id, false AS admin, max(ts) AS last_fetch_at FROM events
             WHERE event_type = 'signup' AND value > 10 GROUP BY user_id),
_ch AS (SELECT user_id, arg_max(ts, ({_ROUND}, ts, event_id)) AS ts FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT coalesce(s.user_id, c.user_id) AS user_id,
       CASE WHEN s.user_id IS NOT NULL THEN s.admin ELSE false END AS admin,
       CASE WHEN c.user_id IS NOT NULL THEN c.ts ELSE s.last_fetch_at END AS last_fetch_at
FROM _st s FULL OUTER JOIN _ch c ON c.user_id = s.user_id""")
def q_stored_upsert(spark, sf):
    """Two written rounds of upserts (even, then odd events), the second one twice."""
    ev = TB.table(spark, sf, "events")
    state = (ev.filter((F.col("event_type") == "signup") & (F.col("value") > 10))
             .groupBy("user_id").agg(F.lit(False).alias("admin"), F.max("ts").alias("last_fetch_at")))
    clicks = ev.filter(F.col("event_type") == "click").select("user_id", "event_id", "ts", F.col("ts").alias("last_fetch_at"))
    table = SD.KeyedTable(spark, _stored_path(spark, "stored-upsert"), state.schema, ["user_id"], 16).create(state)
    for part in (0, 1, 1):
        table.upsert(clicks.filter(F.expr(_ROUND) == part), ["user_id"], ["last_fetch_at"], ["ts", "event_id"],
                     defaults={"admin": F.lit(False)})
    return table.read()


@register("stored_cascade", """
WITH _gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING'))
SELECT 'sources' AS tbl, c_custkey AS id, NULL::BIGINT AS parent FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM _gone)
UNION ALL SELECT 'news', o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM _gone)
UNION ALL SELECT 'sent', l_linenumber, l_orderkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM _gone))""")
def q_stored_cascade(spark, sf):
    """Two written rounds of cascading deletes, the second one twice."""
    cust = TB.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    orders = TB.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    items = TB.table(spark, sf, "lineitem").select("l_linenumber", "l_orderkey")
    store = lambda df, by: SD.KeyedTable(spark, _stored_path(spark, f"stored-{by}"), df.schema, [by], 8).create(df)
    s, n, li = store(cust, "c_custkey"), store(orders, "o_custkey"), store(items, "l_orderkey")
    for segment in ("AUTOMOBILE", "BUILDING", "BUILDING"):
        doomed = cust.filter(F.col("c_mktsegment") == segment).select("c_custkey")
        SD.delete_stored_cascade([(s, "c_custkey"), (n, "o_orderkey"), (li, "l_linenumber")], doomed, "c_custkey")
    rows = lambda df, tbl, key, parent: df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("long").alias("id"),
                                                  parent.cast("long").alias("parent"))
    return (rows(s.read(), "sources", "c_custkey", F.lit(None)).unionByName(rows(n.read(), "news", "o_orderkey", F.col("o_custkey")))
            .unionByName(rows(li.read(), "sent", "l_linenumber", F.col("l_orderkey"))))


_KINDS = ["rss", "web", "x"]  # one landing each, in this order


def _stream_cycles_sql(counts: bool = False) -> str:
    """Three cycles, each with the items of one kind; arrival is by kind, so
    the ids are those of one ingest of all of them."""
    parts, sent = [], "_sent0"
    for k, kind in enumerate(_KINDS, 1):
        upto = ", ".join(f"'{x}'" for x in _KINDS[:k])
        cycle = _cycle_sql(f"c{k}_", sent).replace("JOIN _news n ON true", f"JOIN _news{k} n ON true")
        cycle = cycle.replace(f"c{k}_pend AS (SELECT * FROM (", f"c{k}_pend AS (SELECT * FROM (SELECT * FROM (", 1)
        cycle = cycle.replace('WHERE "rank" <= 50)', f"""WHERE "rank" <= 50) WHERE EXISTS (SELECT 1 FROM _items WHERE source_type = '{kind}'))""", 1)
        parts.append(f"""
_news{k} AS (SELECT p.id, p.source_id, p.title, p.content, p.url, p.published_at, p.fetched_at, {"p.summary_tr" if k == 1 else f"coalesce(d.summ, p.summary_tr) AS summary_tr"}, p.is_column
   FROM (SELECT * FROM _prior UNION ALL SELECT n.* FROM _new n JOIN _fresh f ON f.url = n.url WHERE f.source_type IN ({upto})) p
   {"" if k == 1 else f"LEFT JOIN (SELECT DISTINCT id, summ FROM {' UNION SELECT id, summ FROM '.join(f'c{i}_kept' for i in range(1, k))}) d ON d.id = p.id"}),
{cycle},
_sent{k} AS (SELECT news_id, chat FROM {sent} UNION ALL SELECT news_id, chat_id FROM c{k}_out)""")
        sent = f"_sent{k}"
    outs = " UNION ALL ".join(f'SELECT {k - 1} AS cycle, chat_id, "rank", news_id, message FROM c{k}_out' for k in range(1, len(_KINDS) + 1))
    if counts:
        outs = " UNION ALL ".join(f"""SELECT {k - 1} AS cycle, (SELECT count(*) FROM _fresh WHERE source_type = '{kind}') AS n_added,
  (SELECT count(*) FROM c{k}_pend) AS n_pending, (SELECT count(*) FROM c{k}_pend) - (SELECT count(*) FROM c{k}_out) AS n_removed,
  (SELECT count(*) FROM c{k}_out) AS n_sent""" for k, kind in enumerate(_KINDS, 1))
    return f"WITH RECURSIVE {_CYCLE_BASE_SQL}, {','.join(parts)} {outs}"


@register("stream_cycles", _stream_cycles_sql())
def q_stream_cycles(spark, sf):
    """Three micro-batches of landed files, a delivery cycle each, on stored news, summaries, outbox and sent log."""
    return (_streamed(spark, sf).outbox()
            .select(F.col("batch_id").cast("int").alias("cycle"), "chat_id", "rank", "news_id", "message"))


@register("stream_cycle_counts", _stream_cycles_sql(counts=True))
def q_stream_cycle_counts(spark, sf):
    """Rows added, pending, removed and sent by each of three streamed cycles, observed by the jobs that write them."""
    return (_streamed(spark, sf).counts()
            .select(F.col("batch_id").cast("int").alias("cycle"), "n_added", "n_pending", "n_removed", "n_sent"))


def _streamed(spark, sf):
    sources, land, news, sent, chats, now = _cycle_inputs(spark, sf)
    root = _stored_path(spark, "stream-cycles")
    store = SC.CycleStore.create(f"{root}/flow", news, sent)
    for kind in _KINDS:
        # written by as many tasks as made the rows, and one micro-batch over all their files
        land.filter(F.col("source_type") == kind).write.parquet(f"{root}/landing/{kind}")
        SC.stream_cycles(store, f"{root}/landing", land.schema, sources, chats, now, files_per_cycle=None)
    return store


# ---------------------------------------------------------------------------
# Bucketed state: C2, C6, I1 without a shuffle of the state
# ---------------------------------------------------------------------------
from wirefold.sources import bucketed as BU  # noqa: E402


def _bucketed(spark, df, label: str, keys: list[str], buckets: int = 8):
    return BU.save_bucketed(df, f"{label}_{uuid.uuid4().hex}", _stored_path(spark, label), keys, buckets)


@register("bucketed_insert", f"""
WITH {_LINK_STATE_SQL}
SELECT url, source_id, pos, title FROM _st UNION ALL SELECT url, source_id, pos, title FROM _new""")
def q_bucketed_insert(spark, sf):
    """Insert-or-ignore on a table bucketed by url: only the changes are exchanged."""
    state, changes = _link_state(spark, sf)
    return ST.apply_insert_or_ignore(_bucketed(spark, state, "news_by_url", ["url"]), changes, ["url"],
                                     ["source_type", "source_id", "pos"])


@register("bucketed_unsent", f"""
WITH {_NEWS_SQL}
SELECT id, source_id, fetched_at, source_name FROM _n
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = _n.id AND l.l_returnflag = '{CHAT}')
ORDER BY fetched_at DESC, id DESC LIMIT 50""")
def q_bucketed_unsent(spark, sf):
    """Pending rows of a chat on news and log that are both bucketed by the news id."""
    news = _bucketed(spark, TB.news_orders(spark, sf), "news_by_id", ["id"])
    sent = _bucketed(spark, TB.sent_lineitem(spark, sf), "sent_by_news", ["news_id"])
    return SEL.unsent_news(news, TB.sources_large(spark, sf), sent, CHAT).select("id", "source_id", "fetched_at", "source_name")
