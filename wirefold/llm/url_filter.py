"""URL filters by rules and by a path-template tree (DataFrame operations only).

Rules name a host and a path; they fit the host and its subdomains where the
path starts with theirs, and the longest that fits decides. Other urls are
judged by a template tree, grown one path segment at a time:

1. Digits in a segment are generalised to ``*``, and urls of a host with the
   same such path are one row with counts from here on.
2. Below each node, however deep, a segment stays literal if it is frequent and its labelled
   share of bad pages differs from the node's own (a z-test); rare segments and
   branches that are statistically alike merge into the wildcard branch.
3. A template's purity is its labelled bad share, smoothed towards its host's,
   which is smoothed towards the share of all labels. Templates at or above the
   threshold are rejected.

Aggregates are combined before the shuffle, and the joins that meet a hot host
or template are salted: its rows go to many tasks whatever its share of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm.common import LOWER, UPPER, stored, table

#: Pages below which a segment is generalised.
MIN_SUPPORT = 20
#: Standard errors by which a branch must differ from its node to stay apart.
Z = 2.0
#: Weight of the host's share in a template's, and of all labels' in the host's.
TEMPLATE_WEIGHT, HOST_WEIGHT = 5.0, 10.0
#: Smoothed bad share from which a template is rejected.
REJECT = 0.5
SALTS = 16

# The rules of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Of equal
    rules the first given counts."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        said = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def salted_join(rows: DataFrame, small: DataFrame, keys: list[str], by: list[str], salts: int, how: str = "left") -> DataFrame:
    """Join with a side of one row per key that is copied to ``salts`` parts;
    ``rows`` go to a part by the hash of the columns ``by``."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def lexical_path(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "*")


def template_tree(paths: DataFrame, min_support: int = MIN_SUPPORT, z: float = Z, salts: int = SALTS) -> DataFrame:
    """``paths``: one row per (host, lexical) with n, labelled and bad counts.
    Returns them with ``template``. One round per level, down to the last at
    which a node has ``min_support`` pages: below it no segment can be frequent,
    as a node's pages are among those of the node above."""
    parts = F.split(F.col("lexical"), "/")
    tree = paths.withColumn("segments", F.slice(parts, F.lit(2), F.size(parts))).withColumn("template", F.lit(""))
    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    level = 0
    while True:
        tree = tree.withColumn("segment", F.get("segments", F.lit(level)))
        branch = (tree.filter(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(*counts))
        branch = stored(branch, "url-branches")
        node = branch.groupBy("host", "template").agg(
            F.sum("labelled").alias("of_labelled"), F.sum("bad").alias("of_bad"), F.sum("n").alias("of_n"))
        if node.filter(F.col("of_n") >= min_support).isEmpty():
            break
        frequent = branch.filter(F.col("n") >= min_support)
        share = (F.col("of_bad") + 1.0) / (F.col("of_labelled") + 2.0)
        apart = F.abs(F.col("bad") - F.col("labelled") * share) >= z * F.sqrt(F.col("labelled") * share * (1 - share))
        literal = (salted_join(frequent, node.drop("of_n"), ["host", "template"], ["segment"], salts, "inner")
                   .filter(apart & (F.col("labelled") > 0)).select("host", "template", "segment", F.lit(True).alias("literal")))
        tree = (salted_join(tree, stored(literal, "url-literal"), ["host", "template", "segment"], ["lexical"], salts)
                .withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat(
                    "template", F.lit("/"), F.when(F.col("literal"), F.col("segment")).otherwise("*"))))
                .drop("literal", "segment"))
        tree = stored(tree, "url-tree")
        level += 1
    rest = F.greatest(F.size("segments") - level, F.lit(0))
    return tree.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), rest))).drop("segments", "segment")


def template_purity(tree: DataFrame, template_weight: float = TEMPLATE_WEIGHT, host_weight: float = HOST_WEIGHT) -> DataFrame:
    """(host, template, purity): the smoothed bad share."""
    templates = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    every = tree.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    share = (every["bad"] or 0) / every["labelled"] if every["labelled"] else 0.0
    prior = (F.col("h_bad") + F.lit(host_weight * share)) / (F.col("h_labelled") + F.lit(host_weight))
    return (templates.join(hosts, "host").withColumn("purity", (F.col("bad") + F.lit(template_weight) * prior)
                                                     / (F.col("labelled") + F.lit(template_weight)))
            .select("host", "template", "purity"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id",
                url_col: str = "url", reject: float = REJECT, min_support: int = MIN_SUPPORT, z: float = Z,
                salts: int = SALTS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    ``labels`` has page_id and bad (0 or 1; null is no label; of repeated labels
    any bad one counts). Urls that are null or without ``://`` have empty host and path, and
    are one template of the empty host. Null ids have no label. Repeated rows
    are judged alike and each counts; an empty table gives no rows; further
    columns are not read.
    """
    url = F.col(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    marks = (labels.filter(F.col("bad").isNotNull() & F.col("page_id").isNotNull())
             .groupBy("page_id").agg(F.max("bad").cast("long").alias("is_bad")))
    marked = urls.join(marks, "page_id", "left")
    paths = stored(marked.groupBy("host", lexical_path(F.col("path")).alias("lexical")).agg(
        F.count(F.lit(1)).alias("n"), F.count("is_bad").alias("labelled"),
        F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad")), "url-paths")
    tree = template_tree(paths, min_support, z, salts)
    judged = stored(salted_join(tree.select("host", "lexical", "template"), template_purity(tree), ["host", "template"],
                                ["lexical"], salts), "url-judged")
    found = longest_rule(F.col("host"), F.col("path"), rules)
    rows = urls.withColumn("lexical", lexical_path(F.col("path"))).withColumn("found", found)
    return salted_join(rows, judged, ["host", "lexical"], ["page_id", "path"], salts).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"),
        "template", "purity")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a page are those of the document with its number."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict", "template")


def _sql(depth: int = 8) -> str:
    """The same in SQL, which has no loop over levels here: ``depth`` of them are
    spelled out, and segments below them are wildcards."""
    rules = "CASE " + " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND path LIKE '/{r.partition('/')[2]}%' THEN {{{i}}}"
        for i, (_, r) in enumerate(sorted(RULES, key=lambda x: -len(x[1])))) + " END"
    ordered = sorted(RULES, key=lambda x: -len(x[1]))
    rule = rules.format(*[f"'{r}'" for _, r in ordered])
    verdict = rules.format(*[f"'{v}'" for v, _ in ordered])
    levels, last = [], "t0"
    for k in range(depth):
        levels.append(f"""
b{k} AS (SELECT host, template, parts[{k + 2}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad
  FROM {last} WHERE len(parts) >= {k + 2} GROUP BY 1, 2, 3),
m{k} AS (SELECT host, template, sum(labelled) AS ol, sum(bad) AS ob FROM b{k} GROUP BY 1, 2),
l{k} AS (SELECT b.host, b.template, b.segment FROM b{k} b JOIN m{k} m ON b.host = m.host AND b.template = m.template
  WHERE b.n >= {MIN_SUPPORT} AND b.labelled > 0 AND abs(b.bad - b.labelled * ((ob + 1e0) / (ol + 2e0)))
    >= {Z:e} * sqrt(b.labelled * ((ob + 1e0) / (ol + 2e0)) * (1 - ((ob + 1e0) / (ol + 2e0))))),
t{k + 1} AS (SELECT t.host, t.lexical, t.n, t.labelled, t.bad, t.parts,
  CASE WHEN len(t.parts) < {k + 2} THEN t.template
       ELSE t.template || '/' || CASE WHEN l.segment IS NOT NULL THEN l.segment ELSE '*' END END AS template
  FROM {last} t LEFT JOIN l{k} l ON t.host = l.host AND t.template = l.template AND t.parts[{k + 2}] = l.segment),""")
        last = f"t{k + 1}"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT doc_id, max(1 - quality) AS is_bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
p AS (SELECT host, regexp_replace(path, '[0-9]+', '*', 'g') AS lexical, count(*) AS n, count(is_bad) AS labelled,
  coalesce(sum(is_bad), 0) AS bad FROM u LEFT JOIN k ON u.page_id = k.doc_id GROUP BY 1, 2),
t0 AS (SELECT *, string_split(lexical, '/') AS parts, '' AS template FROM p),{''.join(levels)}
t AS (SELECT host, lexical, labelled, bad, template || repeat('/*', greatest(len(parts) - {depth + 1}, 0)) AS template FROM {last}),
h AS (SELECT host, sum(labelled) AS hl, sum(bad) AS hb FROM t GROUP BY 1),
e AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0e0) AS share FROM t),
q AS (SELECT t.host, t.template, (sum(bad) + {TEMPLATE_WEIGHT:e} * ((any_value(hb) + {HOST_WEIGHT:e} * any_value(share)) / (any_value(hl) + {HOST_WEIGHT:e})))
  / (sum(labelled) + {TEMPLATE_WEIGHT:e}) AS purity FROM t JOIN h ON t.host = h.host CROSS JOIN e GROUP BY 1, 2)
SELECT page_id, u.host, path, {rule.replace('host', 'u.host')} AS rule,
  coalesce({verdict.replace('host', 'u.host')}, CASE WHEN purity >= {REJECT:e} THEN 'block' ELSE 'allow' END) AS verdict, t.template
FROM u JOIN t ON u.host = t.host AND regexp_replace(u.path, '[0-9]+', '*', 'g') = t.lexical
JOIN q ON q.host = t.host AND q.template = t.template
"""


OP1_SQL = _sql()
