"""DuckDB SQL fragments for the oracle queries (the same rules as the Spark
column functions, written for DuckDB so that results can be compared)."""

from __future__ import annotations

from wirefold.functions import markup as M
from wirefold.functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    # DuckDB lower-cases 'İ' to plain 'i'; Python and Spark give 'i' + U+0307.
    low = f"lower(replace(coalesce({x}, ''), 'İ', 'i' || chr(775)))"
    t = f"regexp_replace({low}, {q(T.NON_WORD)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(T.WS_RUN)}, ' ', 'g')"
    return f"trim({t})"


def corpus(title: str, content: str) -> str:
    return norm(f"coalesce({title}, '') || ' ' || coalesce({content}, '')")


def clean(x: str, n: int = T.CLEAN_MAX_CHARS) -> str:
    return f"substring(trim(regexp_replace(coalesce({x}, ''), {q(T.WS_RUN)}, ' ', 'g')), 1, {n})"


def ws_trim(x: str) -> str:
    return f"regexp_replace({x}, {q(T.WS_EDGES)}, '', 'g')"


def keyword_flag(url: str, title: str, keywords=T.COLUMN_KEYWORDS) -> str:
    text = f"lower(coalesce({url}, '') || ' ' || coalesce({title}, ''))"
    return "(" + " OR ".join(f"contains({text}, {q(k)})" for k in keywords) + ")"


def url_base(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '^(https?://[^/]+)', 1)"


def resolve(href: str, page_url: str) -> str:
    b = url_base(page_url)
    return f"(CASE WHEN starts_with({href}, '/') AND {b} <> '' THEN {b} || {href} ELSE {href} END)"


def truncate_title(x: str, n: int = T.TITLE_MAX_CHARS) -> str:
    t = f"coalesce({x}, '')"
    return f"(substring({t}, 1, {n}) || CASE WHEN length({t}) > {n} THEN {q(T.TITLE_ELLIPSIS)} ELSE '' END)"


def rewrite_path(x: str, host: str = T.POST_HOST) -> str:
    p = f"coalesce({x}, '')"
    return f"(CASE WHEN starts_with({p}, '/') THEN {q(host)} || {p} ELSE {p} END)"


def first_nonempty(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def escape_angle(x: str) -> str:
    return f"replace(replace(coalesce({x}, ''), '<', '&lt;'), '>', '&gt;')"


def render(title, summary, content, source_name, url, is_column) -> str:
    return ("('📰 <b>' || " + escape_angle(title) + " || '</b>' || "
            f"CASE WHEN coalesce({is_column}, false) THEN {q(T.COLUMN_TAG)} ELSE '' END || "
            "chr(10) || chr(10) || " + escape_angle(first_nonempty(summary, content)) +
            " || chr(10) || chr(10) || '📌 <i>' || " + escape_angle(source_name) +
            f" || '</i>' || chr(10) || '🔗 ' || coalesce({url}, ''))")


def _entity_map() -> str:
    """The names as a DuckDB map literal."""
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in T.NAMED_ENTITIES.items()) + "}"


def decode_entities(x: str) -> str:
    t = f"coalesce({x}, '')"
    named = (f"list_transform(string_split({t}, '&')[2:], "
             f"lambda p: {{'p': p, 'n': regexp_extract(p, {q(T.ENTITY_RX)}, 1)}})")
    coded = (f"list_transform({named}, lambda s: {{'p': s.p, 'n': s.n, 'c': CASE "
             "WHEN s.n ILIKE '#x%' THEN CAST('0x' || substring(s.n, 3) AS BIGINT) "
             "WHEN s.n LIKE '#%' THEN CAST(substring(s.n, 2) AS BIGINT) END})")
    one = (f"list_transform({coded}, lambda s: CASE "
           "WHEN s.c BETWEEN 1 AND 1114111 AND NOT s.c BETWEEN 55296 AND 57343 "
           f"THEN chr(CAST(s.c AS INTEGER)) || regexp_replace(s.p, {q(T.ENTITY_RX)}, '') "
           f"WHEN s.n = 'amp' THEN '&' || regexp_replace(s.p, {q(T.ENTITY_RX)}, '') "
           f"WHEN s.n <> '' AND s.c IS NULL AND {_entity_map()}[s.n] IS NOT NULL "
           f"THEN {_entity_map()}[s.n] || regexp_replace(s.p, {q(T.ENTITY_RX)}, '') "
           "ELSE '&' || s.p END)")
    return f"(CASE WHEN NOT contains({t}, '&') THEN {t} ELSE string_split({t}, '&')[1] || array_to_string({one}, '') END)"


_MARKUP = "(?is)" + M.markup_rx("")  # this engine has no possessive sign and needs none


def html_to_text(h: str) -> str:
    return decode_entities(f"regexp_replace(coalesce({h}, ''), {q(_MARKUP)}, ' ', 'g')")


def node_text_joined(inner: str) -> str:
    return ("array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(" + inner +
            f", ''), {q(_MARKUP)}), lambda p: " + ws_trim(decode_entities("p")) + "), lambda p: p <> ''), '')")


def terms_of(norm_expr: str) -> str:
    """Unigrams then bigrams of a normalised text, as a DuckDB list."""
    t = f"list_filter(string_split({norm_expr}, ' '), lambda x: length(x) >= 2)"
    # the token list is bound once, by a lambda over a list that holds it
    return (f"list_transform([{t}], lambda t: list_concat(t, list_transform(list_zip(t[1:len(t) - 1], t[2:]), "
            "lambda z: z[1] || ' ' || z[2])))[1]")


def tfidf_ctes(items: str, max_features: int | None = 5000) -> str:
    """CTEs over ``items(batch, pos, norm)`` ending in ``wts(batch, pos, term, wt)``;
    all terms without ``max_features``."""
    vocab = "SELECT * FROM _dfs" if max_features is None else (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY total DESC, term ASC) AS vr "
        f"FROM _dfs) WHERE vr <= {max_features}")
    return f"""
_toks AS (SELECT batch, pos, unnest({terms_of('norm')}) AS term FROM {items} WHERE norm <> ''),
_tf AS (SELECT batch, pos, term, count(*) AS tf FROM _toks GROUP BY batch, pos, term),
_dfs AS (SELECT batch, term, count(*) AS df, sum(tf) AS total FROM _tf GROUP BY batch, term),
_vocab AS ({vocab}),
_nv AS (SELECT batch, count(*) AS n FROM {items} WHERE norm <> '' GROUP BY batch),
_w0 AS (SELECT t.batch, t.pos, t.term, v.df, t.tf * (ln((1.0 + n.n) / (1.0 + v.df)) + 1.0) AS w
        FROM _tf t JOIN _vocab v ON v.batch = t.batch AND v.term = t.term JOIN _nv n ON n.batch = t.batch),
wts AS (SELECT batch, pos, term, df, w / sqrt(sum(w * w) OVER (PARTITION BY batch, pos)) AS wt FROM _w0)"""


def pairs_cte(threshold: float = 0.75) -> str:
    return f"""
pairs AS (SELECT a.batch, a.pos AS i, b.pos AS j, sum(a.wt * b.wt) AS sim
          FROM wts a JOIN wts b ON a.batch = b.batch AND a.term = b.term AND a.pos < b.pos
          GROUP BY a.batch, a.pos, b.pos HAVING sum(a.wt * b.wt) >= {threshold})"""


def greedy_ctes() -> str:
    """Sequential first-wins walk over ``pairs`` as a recursive CTE, ending in
    ``gone(batch, pos)``: the removed rows."""
    return """
_tgt AS (SELECT batch, j, list(i) AS nb, row_number() OVER (PARTITION BY batch ORDER BY j) AS k
         FROM pairs GROUP BY batch, j),
_last AS (SELECT batch, max(k) AS mk FROM _tgt GROUP BY batch),
_walk(batch, k, removed) AS (
    SELECT batch, 0::BIGINT, []::BIGINT[] FROM _last
    UNION ALL
    SELECT w.batch, w.k + 1,
           CASE WHEN list_has_all(w.removed, t.nb) THEN w.removed ELSE list_append(w.removed, t.j) END
    FROM _walk w JOIN _tgt t ON t.batch = w.batch AND t.k = w.k + 1),
gone AS (SELECT w.batch, unnest(w.removed) AS pos FROM _walk w JOIN _last l ON l.batch = w.batch AND l.mk = w.k)"""


def doc_items(batch_rows: int = 50) -> str:
    """``documents`` cut into batches per source in doc_id order."""
    return f"""
_d AS (SELECT doc_id, source, text, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
items AS (SELECT doc_id, source, text, lang, rn AS pos,
                 source || ':' || CAST((rn - 1) // {batch_rows} AS VARCHAR) AS batch,
                 {corpus('NULL', 'text')} AS norm FROM _d)"""


_ATTRIBUTE = M.ATTRIBUTE.replace("++", "+").replace("*+", "*")


def anchors_ctes(pages_sql: str = "SELECT page_id AS source_id, url AS page_url, html AS body FROM pages") -> str:
    """CTEs ending in ``anchors(source_id, page_url, pos, href, text)``."""
    rx = f"(?is)({M.anchor_rx('')})|({M.markup_rx('')})"
    tag = "split_part(w, chr(2), 1)"
    plain = "translate(coalesce(body, ''), chr(1) || chr(2), '')"
    marked = f"regexp_replace({plain}, {q(rx)}, chr(1) || '\\1' || chr(2) || '\\2', 'g')"
    return f"""
_pg AS (SELECT source_id, page_url, string_split(replace({marked}, chr(1) || chr(2), ''), chr(1))[2:] AS ws FROM ({pages_sql})),
_an1 AS (SELECT source_id, page_url, unnest(generate_series(1, len(ws))) AS k, unnest(ws) AS w FROM _pg),
_an2 AS (SELECT *, regexp_extract_all({tag}, {q(_ATTRIBUTE)}, 1) AS ns, regexp_extract_all({tag}, {q(_ATTRIBUTE)}, 2) AS vs
         FROM _an1 WHERE NOT starts_with(w, '</')),
_an3 AS (SELECT *, vs[list_position(list_transform(ns, lambda n: lower(n)), 'href')] AS v FROM _an2),
_an AS (SELECT source_id, page_url, w, row_number() OVER (PARTITION BY source_id ORDER BY k) - 1 AS pos,
               CASE WHEN v[1] IN ('"', chr(39)) THEN substring(v, 2, length(v) - 2) ELSE v END AS raw FROM _an3 WHERE v IS NOT NULL),
anchors AS (SELECT source_id, page_url, pos, {decode_entities('raw')} AS href,
                   {node_text_joined("substring(w, instr(w, chr(2)) + 1)")} AS text FROM _an)"""


def page_links_ctes(min_title: int = 15, limit: int = 15, out: str = "links") -> str:
    """CTEs after ``anchors_ctes`` ending in ``{out}`` (web items)."""
    return f"""
_pl0 AS (SELECT *, {resolve('href', 'page_url')} AS link FROM anchors
         WHERE text <> '' AND length(text) >= {min_title}),
_pl2 AS (SELECT *, row_number() OVER (PARTITION BY source_id, link ORDER BY pos) AS k
         FROM _pl0 WHERE starts_with(link, 'http')),
_pl3 AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS n FROM _pl2 WHERE k = 1),
{out} AS (SELECT 'web' AS source_type, source_id, pos, text AS title, '' AS content, link AS url,
                 NULL::VARCHAR AS published_at, {keyword_flag('link', 'text')} AS is_column
          FROM _pl3 WHERE n <= {limit})"""


XML_INVALID = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"


def feed_items_ctes(out: str = "feed_items", where: str = "true") -> str:
    """Expected RSS items straight from ``documents`` (what the feed XML built
    from them must parse back to)."""
    return f"""
_f AS (SELECT doc_id // 20 + 1000000000 AS source_id, doc_id, lang, source,
              regexp_replace(text, {q(XML_INVALID)}, '', 'g') AS t FROM documents),
_f2 AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) - 1 AS pos,
               {ws_trim("split_part(t, chr(10), 1)")} AS title,
               CASE WHEN lang = 'de' THEN '' ELSE 'https://' || source || '.example.org/doc/' || CAST(doc_id AS VARCHAR) END AS link
        FROM _f),
{out} AS (SELECT 'rss' AS source_type, source_id, pos, title,
                 {clean(html_to_text("'<p>' || t || '</p>'"))} AS content, link AS url,
                 'doc-' || CAST(doc_id AS VARCHAR) AS published_at, {keyword_flag('link', 'title')} AS is_column
          FROM _f2 WHERE pos < 15 AND link <> '' AND title <> '' AND {where})"""


def timeline_posts_ctes(out: str = "posts", where: str = "true") -> str:
    """Expected timeline posts straight from ``conversations``."""
    return f"""
_c AS (SELECT 2000000000 + conv_id * 1000000 + turn // 20 AS source_id, conv_id, turn, role, text,
              row_number() OVER (PARTITION BY conv_id, turn // 20 ORDER BY turn) - 1 AS pos FROM conversations),
_c2 AS (SELECT *, {clean('text')} AS content FROM _c WHERE pos < 10 AND role <> 'system'),
{out} AS (SELECT 'x' AS source_type, source_id, pos, {truncate_title('content')} AS title, content,
                 'https://twitter.com/u' || CAST(conv_id AS VARCHAR) || '/status/' || CAST(turn AS VARCHAR) AS url,
                 NULL::VARCHAR AS published_at, false AS is_column
          FROM _c2 WHERE content <> '' AND {where})"""
