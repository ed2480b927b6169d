"""URL filters with redirect equivalence.

A rule names a host and a path's start; it fits the host and its subdomains, and the longest fitting
rule decides. Pages without a rule take the decision of their aliases: URLs tied by redirects and by
canonical links form components, and a component with a blocked URL is blocked unless one of its URLs
is explicitly allowed, which takes precedence; a component without either is allowed.

A null URL, or one without ``://``, has empty host and path, fits no rule and has no aliases. Null or
empty HTML gives no edges. Repeated rows are judged each; rules of equal length can't fit one URL unless
they are the same, and of such the first by text wins. An empty table gives an empty result. Columns
beyond id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import connected_components

#: (host and path, verdict), the rules of the registered query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "block")]

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """A URL as a node: scheme and host lower-cased, without the fragment; null if it has no ``://``."""
    plain = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(plain, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(plain.contains("://"), F.concat(lower_ascii(head), plain.substr(F.length(head) + 1, F.length(plain))))


def matched_rule(host: Column, path: Column, rules=None) -> Column:
    """The longest fitting rule as text, or null. The rules are a fixed list, so this is one expression."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules or RULES, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        at = (rule + "/").index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=None) -> Column:
    out = F.lit(None).cast("string")
    for text, verdict in rules or RULES:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


_LINK = r"(?is)<link\b[^>]*>"
_META = r"(?is)<meta\b[^>]*>"


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0)
    value = F.regexp_replace(found, rf"(?is)^\s{name}\s*=\s*", "")
    return F.replace(F.regexp_replace(value, r"^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&"))


def _absolute(target: Column, url: Column) -> Column:
    """A link's target as a whole URL: scheme-relative, root-relative and relative forms are completed."""
    t = F.trim(target)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#/]*)*?/?)[^/?#]*(?:[?#].*)?$", 1)
    return (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), t))
        .when(t.startswith("/"), F.concat(root, t))
        .when((t == "") | t.startswith("#"), url)
        .when(t.startswith("?"), F.concat(F.regexp_replace(url, r"(?s)[?#].*$", ""), t))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/"))), t))
    )


def alias_edges(pages: DataFrame, work: Workspace) -> DataFrame:
    """``a, b`` URL keys: from canonical links and from refresh redirects in the pages' HTML."""
    has = F.lower(F.coalesce(F.col("html"), F.lit("")))
    p = pages.select("url", "html").where(F.col("url").contains("://") & (has.contains("canonical") | has.contains("refresh")))
    links = p.select("url", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0))).alias("tag"))
    links = links.where(F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)")).select("url", _attribute(F.col("tag"), "href").alias("to"))
    metas = p.select("url", F.explode(F.regexp_extract_all("html", F.lit(_META), F.lit(0))).alias("tag"))
    metas = metas.where(F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh")
    content = _attribute(F.col("tag"), "content")
    metas = metas.where(content.rlike(r"(?is)url\s*=")).select("url", F.regexp_extract(content, r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1).alias("to"))
    both = work.save(links.unionAll(metas).where(F.trim("to") != ""))  # written, so that the addresses below are short expressions
    return both.select(url_key(F.col("url")).alias("a"), url_key(_absolute(F.col("to"), F.col("url"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row. ``redirects``: more edges, ``from_url, to_url``."""
    work = Workspace(pages.sparkSession, "url_filter")
    edges = alias_edges(pages, work)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(url_key(F.col("from_url")).alias("a"), url_key(F.col("to_url")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    edges = work.save(edges.where("a <> b").distinct())
    rows = pages.select("page_id", F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    own = F.coalesce(verdict_of(F.col("rule"), rules), F.lit("none"))
    if edges.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.when(own == "none", F.lit("allow")).otherwise(own).alias("verdict"))
    parts = connected_components(edges, work)
    # Every URL of a component counts, whether it is a row of pages or only the target of a link.
    judged = parts.withColumn("own", verdict_of(matched_rule(host_of(F.col("node")), path_of(F.col("node")), rules), rules))
    groups = judged.groupBy("component").agg(F.bool_or(F.coalesce(F.col("own") == 'block', F.lit(False))).alias("blocked"), F.bool_or(F.coalesce(F.col("own") == 'allow', F.lit(False))).alias("allowed"))
    passed = parts.join(groups, "component").select(F.col("node"), F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow").alias("passed"))
    rows = rows.withColumn("node", url_key(F.col("url"))).join(work.save(passed), "node", "left")
    return rows.select("page_id", "host", "path", "rule", F.when(own == "none", F.coalesce("passed", F.lit("allow"))).otherwise(own).alias("verdict"))


ORACLE = """
WITH RECURSIVE r(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'block'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
split AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM r),
urls AS (
  SELECT DISTINCT url FROM pages WHERE url IS NOT NULL
  UNION SELECT regexp_extract(html, '<link rel="canonical" href="([^"]+)"', 1) FROM pages WHERE html LIKE '%<link rel="canonical" href="%'),
u AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(url, '(?s)#.*$', '') AS node FROM urls),
j AS (
  SELECT u.*, (SELECT arg_max(rule, length(rule)) FROM split WHERE (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)) AS rule FROM u),
e AS (
  SELECT regexp_replace(url, '(?s)#.*$', '') AS a, regexp_replace(regexp_extract(html, '<link rel="canonical" href="([^"]+)"', 1), '(?s)#.*$', '') AS b
  FROM pages WHERE html LIKE '%<link rel="canonical" href="%' AND url LIKE '%://%'),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(x, y) AS (SELECT a, a FROM b UNION SELECT x, b.b FROM reach JOIN b ON reach.y = b.a),
near AS (
  SELECT x, bool_or(r.verdict = 'block') AS blocked, bool_or(r.verdict = 'allow') AS allowed
  FROM reach JOIN j ON j.node = reach.y LEFT JOIN r ON r.rule = j.rule GROUP BY x)
SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule,
       coalesce(r.verdict, CASE WHEN near.blocked AND NOT coalesce(near.allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN j ON j.url = p.url LEFT JOIN r ON r.rule = j.rule LEFT JOIN near ON near.x = j.node
"""
