"""URL rules whose block decisions reach redirects and canonical links (DataFrame functions only).

A URL's node is its host and path.  A rule (host, path prefix) fits its host and all subdomains;
the longest fitting rule decides.  Pages without a rule follow the method: redirect and canonical
links are edges between nodes, connected components are the aliases of one page, and a component
with a node that a rule blocks is blocked.  A rule that allows a page itself is never overridden;
everything else is allowed.

Edges come from the pages (`link` tags whose rel has the token canonical, `meta` tags with http-equiv
refresh; none in comments; a tag ends at its first `>`) and from a table of redirects (src, dst URLs) if
one is given.  Relative links are resolved against the page's URL, dot segments are removed.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and has no
links; null html has no links; very long html is read whole; null ids and repeated rows give rows like
any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.components import connected_components
from quarry.session import checkpointed

#: (decision, host, path prefix).  Fixed values of the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its decision) of the longest rule that fits, else nulls."""
    rule = decision = None
    for word, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        decision = F.when(fits, word) if decision is None else decision.when(fits, word)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, decision)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, with or without quotes; empty without it."""
    value = f"(?is)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)])


def decoded(text: Column) -> Column:
    """Without the character references that occur in URLs, and trimmed."""
    for name, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")


def page_links(pages: DataFrame) -> DataFrame:
    """(src_host, src_path, link) of canonical links and refreshes outside of comments; one pass over the html."""
    html = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    tags = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", F.explode(F.regexp_extract_all(html, F.lit("(?is)<(?:link|meta)\\s[^>]*>"), 0)).alias("tag"))
    rel = F.split(F.lower(attribute(F.col("tag"), "rel")), "[\\x20\\x09-\\x0D]+")
    canonical = F.col("tag").rlike("(?i)^<link") & F.array_contains(rel, "canonical")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower(attribute(F.col("tag"), "http-equiv")) == "refresh")
    content = F.regexp_extract(attribute(F.col("tag"), "content"), "(?is)^[^;,]*[;,]\\s*url\\s*=\\s*[\"']?([^\"']*)", 1)
    link = decoded(F.when(canonical, attribute(F.col("tag"), "href")).when(refresh, content))
    return tags.select(host_of(F.col("url")).alias("src_host"), path_of(F.col("url")).alias("src_path"), link.alias("link")).where("link != '' AND src_host != ''")


def resolved(host: Column, path: Column, link: Column) -> Column:
    """The absolute URL of a link on the page host + path (null for other schemes, such as mailto)."""
    bare = F.regexp_extract(link, "(?s)^[^?#]*", 0)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("/"), F.concat(F.lit("x://"), host, link))
        .when(bare == "", F.concat(F.lit("x://"), host, path))
        .otherwise(F.concat(F.lit("x://"), host, F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), bare))
    )


def node_of(host: Column, path: Column) -> Column:
    """Host and path in one text (a host has no slash), without dot segments; an empty path is the root."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/")
    kept = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step), "/")
    plain = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.lit("/"))).otherwise(kept)
    return F.concat(host, F.when(path == "", "/").when(path.contains("/."), plain).otherwise(path))


def edges_of(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(src, dst) nodes."""
    links = page_links(pages).select("src_host", "src_path", resolved(F.col("src_host"), F.col("src_path"), F.col("link")).alias("dst"))
    if redirects is not None:
        links = links.unionByName(redirects.select(host_of(F.col("src")).alias("src_host"), path_of(F.col("src")).alias("src_path"), "dst"))
    links = links.select("src_host", "src_path", host_of(F.col("dst")).alias("dst_host"), path_of(F.col("dst")).alias("dst_path")).where("src_host != '' AND dst_host != ''")
    return links.select(node_of(F.col("src_host"), F.col("src_path")).alias("src"), node_of(F.col("dst_host"), F.col("dst_path")).alias("dst"))


def judged(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    groups = checkpointed(connected_components(edges_of(pages, redirects)))
    node_host, node_path = F.regexp_extract("node", "(?s)^[^/]*", 0), F.regexp_extract("node", "(?s)^[^/]*(.*)$", 1)
    blocked = groups.where(rule_of(node_host, node_path, rules)[1] == "block").select("component").distinct()
    aliases = groups.join(blocked, "component", "left_semi").select(F.col("node").alias("alias")).distinct()
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, decision = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), decision.alias("decision"))
    found = rows.join(aliases, node_of(F.col("host"), F.col("path")) == F.col("alias"), "left")
    verdict = F.coalesce("decision", F.when(F.col("alias").isNotNull(), "block"), F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op7_url_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _sql() -> str:
    """The same in DuckDB's SQL: attributes by one list of matches a tag, dot segments by a fold over text."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN " for _, h, p in ordered]
    rule = "CASE " + " ".join(f + f"'{h}{p}'" for f, (_, h, p) in zip(fits, ordered)) + " END"
    decision = "CASE " + " ".join(f + f"'{w}'" for f, (w, _, _) in zip(fits, ordered)) + " END"
    after = lambda c: f"substr({c}, strpos({c}, '://') + 3)"
    host = lambda c: f"CASE WHEN contains({c}, '://') THEN translate(regexp_extract({after(c)}, '^[^/?#]*', 0, 's'), '{UPPER}', '{LOWER}') ELSE '' END"
    path = lambda c: f"CASE WHEN contains({c}, '://') THEN regexp_extract({after(c)}, '^[^/?#]*([^?#]*)', 1, 's') ELSE '' END"
    fold = "list_reduce(string_split(path, '/'), lambda done, part: CASE part WHEN '..' THEN regexp_replace(done, '/?[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || part END)"
    node = f"host || CASE WHEN path = '' THEN '/' WHEN contains(path, '/.') THEN {fold} || CASE WHEN regexp_matches(path, '/[.][.]?$') THEN '/' ELSE '' END ELSE path END"
    attribute = lambda n: f"regexp_replace(regexp_extract(tag, '\\s{n}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1, 'is'), '^[\"'']|[\"'']$', '', 'g')"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, coalesce({host("url")}, '') AS host, coalesce({path("url")}, '') AS path, regexp_replace(html, '<!--.*?-->', '', 'gs') AS html FROM pages),
tags AS (SELECT host, path, unnest(regexp_extract_all(html, '<(?:link|meta)\\s[^>]*>', 0, 'is')) AS tag FROM p WHERE host <> ''),
raw AS (
  SELECT host, path, CASE
    WHEN regexp_matches(tag, '^<link', 'i') AND list_contains(regexp_split_to_array(lower({attribute("rel")}), '\\s+'), 'canonical') THEN {attribute("href")}
    WHEN regexp_matches(tag, '^<meta', 'i') AND lower({attribute("http-equiv")}) = 'refresh' THEN regexp_extract({attribute("content")}, '^[^;,]*[;,]\\s*url\\s*=\\s*["'']?([^"'']*)', 1, 'is') END AS link
  FROM tags
), links AS (
  SELECT host, path, regexp_replace(replace(replace(replace(replace(replace(replace(link, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&#38;', '&'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g') AS link
  FROM raw
), targets AS (
  SELECT host, path, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ''
    WHEN starts_with(link, '//') THEN 'x:' || link
    WHEN starts_with(link, '/') THEN 'x://' || host || link
    WHEN regexp_matches(link, '^[?#]') THEN 'x://' || host || path
    ELSE 'x://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^.*/', 0, 's') END || regexp_extract(link, '^[^?#]*', 0, 's') END AS dst
  FROM links WHERE link <> ''
), there AS (SELECT {node} AS src, {host("dst")} AS dst_host, {path("dst")} AS dst_path FROM targets),
one_way AS (SELECT src, {node} AS dst FROM (SELECT src, dst_host AS host, dst_path AS path FROM there WHERE dst_host <> '')),
both_ways AS (SELECT src, dst FROM one_way UNION SELECT dst, src FROM one_way),
nodes AS (SELECT DISTINCT src AS node, regexp_extract(src, '^[^/]*', 0, 's') AS host, regexp_extract(src, '^[^/]*(.*)$', 1, 's') AS path FROM both_ways),
bad(node) AS (
  SELECT node FROM nodes WHERE {decision} = 'block'
  UNION SELECT e.dst FROM bad JOIN both_ways e ON e.src = bad.node
)
SELECT page_id, host, path, {rule} AS rule,
  coalesce({decision}, CASE WHEN {node} IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""


OP7_SQL = _sql()
