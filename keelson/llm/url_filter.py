"""URL filter by redirect equivalence.

Rules (verdict, host, path) judge a URL by itself; the longest that fits wins. URLs that name the same page, by a
canonical link, a meta refresh or a table of redirects, are edges of a graph over normalised URLs. Its connected
components are found in Spark; a URL without a rule of its own takes the block decision of its component, unless some URL
there is explicitly allowed. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import skew
from keelson.llm.exact_dedup import LOWER, UPPER
from keelson.llm.graph import components
from keelson.llm.staging import materialise

#: (verdict, host, path): the rules of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
HOST, PATH, QUERY = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)", r"(?s)^.*?://[^?#]*(\?[^#]*)"
#: What the tags of a page are not looked for in; an unclosed comment or script goes on to the end.
HIDDEN = r"(?is)<!--(?:.*?-->|.*)|<(script|style)\b(?:.*?</\1\s*>|.*)"
TAG = r"(?is)<(?:link|meta)\s[^<>]*>"
#: Folders of a path, with the last blank: what a relative link starts from.
FOLDER = r"(?s)^(.*/)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The name of a URL in the graph: host, path (``/`` if empty) and query, without scheme and fragment; NULL without a host."""
    host, path = host_of(url), path_of(url)
    name = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.regexp_extract(url, QUERY, 1))
    return F.when(host != "", name)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equally long ones that of the longer host; NULL where none fits.

    The rules are a short list: they are compiled into one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty if it isn't there."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def target_of(tag: Column) -> Column:
    """Where a link or meta tag says that the page is: the canonical link, or the address of a refresh; else empty."""
    refresh = F.regexp_extract(attribute(tag, "content"), r"""(?is)\burl\s*=\s*['"]?([^'"]*)""", 1)
    canonical = F.lower(attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)")
    return F.when(tag.rlike(r"(?i)^<link") & canonical, attribute(tag, "href")).when(
        tag.rlike(r"(?i)^<meta") & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh"), refresh).otherwise(F.lit(""))


def resolved(link: Column, url: Column) -> Column:
    """A link of the page at ``url`` as a whole URL: with a scheme, ``//host``, ``/path``, ``?query`` or a path from the page's folder."""
    root = F.concat(F.lit("x://"), host_of(url))
    folder = F.regexp_extract(F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), FOLDER, 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("x:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path_of(url), link))
        .otherwise(F.concat(root, folder, link))
    )


def once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``value``, worked out once a row: Spark would repeat it in every expression that uses it, but not past a generator."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes that a page's canonical links and refreshes make one. The tags of comments, scripts and styles don't count.

    Links of other schemes that have no ``//`` (mailto:), of fragments and of nothing are no edges. A tag ends at its first ``>``, and holds no ``<``.
    """
    url, html = F.col("_url"), F.col("_html")
    named = pages.select(F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).where(html.rlike("(?i)canonical|refresh"))
    tags = named.select("_url", F.explode(F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(TAG), F.lit(0))).alias("_tag"))
    links = once(tags, "_link", F.trim(F.replace(target_of(F.col("_tag")), F.lit("&amp;"), F.lit("&"))), "_url")
    other = F.col("_link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)")
    links = links.where((F.col("_link") != "") & ~F.startswith(F.col("_link"), F.lit("#")) & ~other)
    ends = once(links, "_to", resolved(F.col("_link"), url), "_url")
    return once(ends, "_ends", F.struct(node_of(url).alias("a"), node_of(F.col("_to")).alias("b"))).select("_ends.a", "_ends.b")


def url_filter(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, alias (whether its component decided).

    ``rules`` are (verdict, host, path) with verdict allow or block; a rule fits its host and all subdomains, if the path
    starts with the rule's. ``redirects`` is a table (src, dst) of URLs known from elsewhere, beside what pages say.
    A URL with a rule has that rule's verdict. One without is blocked if a rule blocks a URL of its component, seen as a
    page or only as a target, and none allows one; else it is allowed. A null URL, and one without ``://``, has
    an empty host and path, fits no rule and is in no component: allowed. Null html has no links. Repeated identifiers and
    URLs are rows of their own with the same verdict. An empty table gives an empty one; other columns are ignored.
    URLs and pages may be long; a component may hold any share of all rows, as its decision is two counts.
    """
    url = F.col("_url")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    rows = rows.select("_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("_node"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)

    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")))
    found = materialise(components(edges.where("a IS NOT NULL AND b IS NOT NULL")))
    as_url = F.concat(F.lit("x://"), F.col("node"))
    _, own = ruled(host_of(as_url), path_of(as_url), rules)
    found = found.withColumn("own", own)
    says = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") == "block").alias("n_block"), F.count_if(F.col("own") == "allow").alias("n_allow"))
    says = materialise(says)
    large = skew.large_keys(says, ["component"], found.count())
    blocked = says.where("n_block > 0 AND n_allow = 0").select("component", F.lit(True).alias("_alias"))
    aliases = materialise(skew.join(found.where("own IS NULL"), blocked, ["component"], large).select("node", "_alias"))
    # One row a node on the right; Spark broadcasts it where its size allows, and splits a node that very many rows share.
    out = rows.join(aliases, (F.col("_node") == F.col("node")) & F.col("rule").isNull(), "left")
    alias = F.coalesce("_alias", F.lit(False))
    return out.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(alias, "block").otherwise("allow")).alias("verdict"), alias.alias("alias")
    )


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("alias")


def _sql() -> str:
    fits = lambda h, p, r: f"(({h} = '{r[1]}' OR {h} LIKE '%.{r[1]}') AND starts_with({p}, '{r[2]}'))"
    by_length = sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), reverse=True)
    case = lambda h, p, k: "CASE " + " ".join(f"WHEN {fits(h, p, r)} THEN '{r[0] if k else r[1] + r[2]}'" for r in by_length) + " END"
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    host = lambda u: f"coalesce({low.format(f'regexp_extract({u}, {chr(39)}{HOST}{chr(39)}, 1)')}, '')"
    path = lambda u: f"coalesce(regexp_extract({u}, '{PATH}', 1), '')"
    node = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END || regexp_extract({u}, '{QUERY}', 1) END"
    attr = lambda n: "(" + " || ".join(f"regexp_extract(tag, '(?is)\\s{n}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s>\"'']+))', {k})" for k in (1, 2, 3)) + ")"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
r AS (SELECT *, {case('host', 'path', 0)} AS rule, {case('host', 'path', 1)} AS own FROM p),
-- RE2 has no back references: scripts and styles go one after the other
c AS (SELECT url, host, path, node, regexp_replace(regexp_replace(html, '(?is)<!--(?:.*?-->|.*)|<script\\b(?:.*?</script\\s*>|.*)', ' ', 'g'), '(?is)<style\\b(?:.*?</style\\s*>|.*)', ' ', 'g') AS html
      FROM p WHERE regexp_matches(html, '(?i)canonical|refresh')),
t AS (SELECT url, host, path, node, unnest(regexp_extract_all(html, '{TAG}')) AS tag FROM c),
g AS (SELECT *, CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(lower({attr('rel')}), '(^|\\s)canonical(\\s|$)') THEN {attr('href')}
                     WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim({attr('http-equiv')})) = 'refresh' THEN regexp_extract({attr('content')}, '(?is)\\burl\\s*=\\s*[''"]?([^''"]*)', 1) ELSE '' END AS target FROM t),
k AS (SELECT *, trim(replace(target, '&amp;', '&')) AS link FROM g),
l AS (SELECT node, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN 'x:' || link WHEN starts_with(link, '/') THEN 'x://' || host || link
                  WHEN starts_with(link, '?') THEN 'x://' || host || path || link ELSE 'x://' || host || regexp_extract(CASE WHEN path = '' THEN '/' ELSE path END, '{FOLDER}', 1) || link END AS url
      FROM k WHERE link <> '' AND NOT starts_with(link, '#') AND (NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://'))),
e AS (SELECT node AS a, {node('url')} AS b FROM l),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b),
v AS (SELECT a, {case(host("'x://' || b"), path("'x://' || b"), 1)} AS own FROM reach),
s AS (SELECT a FROM v GROUP BY a HAVING count(*) FILTER (own = 'block') > 0 AND count(*) FILTER (own = 'allow') = 0)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IN (SELECT a FROM s) THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


ORACLE = _sql()
