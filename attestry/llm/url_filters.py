"""URL filters: longest rule by host and path, then decisions carried over redirects and canonical links.

Pages and link targets are vertices, named by host, path (empty: ``/``) and query. A page's ``rel=canonical``
links and its ``http-equiv=refresh`` targets are edges. A component that holds a page which a rule blocks
is blocked, and one that holds a page which a rule allows is allowed, whatever else it holds; pages
with a rule of their own keep that rule's verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import checkpoint
from attestry.llm.components import connected_components

#: Fixed values of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls.

    The rules are a constant of the query, not a table, so the match is one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _node(url: Column) -> Column:
    query = F.coalesce(F.regexp_extract(url, r"(?s)\A[^?#]*(\?[^#]*)", 1), F.lit(""))
    path = path_of(url)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def resolve(url: str, target: str) -> str:
    """The address that a target, absolute or relative, has on a page; ``url`` holds ``://``."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        return target
    scheme, host, path, query = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?", url).groups()
    if target.startswith("//"):
        return f"{scheme}:{target}"
    told, rest = re.match(r"(?s)([^?#]*)(.*)", target).groups()
    if not told:
        return f"{scheme}://{host}{path}{rest if rest.startswith('?') else (query or '') + rest}"
    parts = (told if told.startswith("/") else path[: path.rfind("/") + 1] + told).removeprefix("/").split("/")
    out = []
    for k, part in enumerate(parts):
        if part == "..":
            out = out[:-1]
        elif part != ".":
            out.append(part)
        if part in (".", "..") and k == len(parts) - 1:
            out.append("")
    return f"{scheme}://{host}/{'/'.join(out)}{rest}"


#: Fixed values of the format: elements whose content is text, whatever it looks like.
TEXT_ELEMENTS = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
WHITE = " \t\n\f\r"
#: Attributes of a tag: quotes count after an equals sign only, and one that is never closed runs to the end of the page.
ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?+"""
ATTRIBUTES = re.compile(ATTRIBUTE, re.ASCII)
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{re.sub(r'(?<!\\)\((?!\?)', '(?:', ATTRIBUTE)})*+)>", re.ASCII)
COMMENT = re.compile(r"(?s)<!--(?:-?>|.*?(?:--!?>|\Z))")
REFERENCE = re.compile(r"&(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*)(;?)(=?))")


def _referred(m: re.Match) -> str:
    """What a character reference in an attribute stands for; a name without its semicolon before an equals sign is no reference."""
    if m[3]:
        told = html5.get(m[3] + m[4])
        return m[0] if told is None or (m[5] and not m[4]) else told + m[5]
    n = int(m[1] or m[2], 10 if m[1] else 16)
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"


def tags(html: str) -> Iterator[tuple[str, dict[str, str]]]:
    """The start tags of a page with their attributes, in order; of attributes told twice, the first.

    Comments, the content of text elements and of templates, and a tag that the page's end cuts off give none.
    """
    at, inert = html.find("<"), 0
    while at >= 0:
        if html.startswith("<!--", at):
            at = html.find("<", COMMENT.match(html, at).end())
            continue
        after = html[at + 1 : at + 2]
        if after in ("!", "?") or (after == "/" and not re.match("[a-zA-Z]", html[at + 2 : at + 3])):
            end = html.find(">", at)
            at = html.find("<", end) if end >= 0 else -1
            continue
        if not re.match("[a-zA-Z/]", after):
            at = html.find("<", at + 1)
            continue
        m = TAG.match(html, at)
        if m is None:
            return
        name, at = m[2].lower(), m.end()
        if name == "template":
            inert = max(0, inert - 1) if m[1] else inert + 1
        elif not m[1]:
            if name == "plaintext":
                return
            if not inert and name in ("link", "meta", "base"):
                told: dict[str, str] = {}
                for key, value in ATTRIBUTES.findall(m[3]):
                    told.setdefault(key.lower(), REFERENCE.sub(_referred, value[1:-1] if value[:1] in ("'", '"') else value))
                yield name, told
            if name in TEXT_ELEMENTS:
                end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE | re.ASCII).search(html, at)
                if end is None:
                    return
                at = end.start()
        at = html.find("<", at)


def target_of(name: str, attributes: dict[str, str]) -> str | None:
    """Where a canonical link or a refresh points to, as it is told; null for any other tag."""
    told = None
    if name == "link" and "canonical" in attributes.get("rel", "").lower().split():
        told = attributes.get("href")
    elif name == "meta" and attributes.get("http-equiv", "").strip(WHITE).lower() == "refresh":
        m = re.match(r"(?is)\s*(?:[0-9]|(?=\.))[0-9.]*(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(?:'([^']*)|\"([^\"]*)|(.*))", attributes.get("content", ""))
        told = m and (m[1] or m[2] or m[3])
    told = told and re.sub(r"[\t\n\r]", "", told.strip("".join(map(chr, range(33)))))
    return told or None


def targets_of(url: str, html: str) -> list[str]:
    """The addresses that a page's canonical links and refreshes lead to; ``url`` holds ``://``.

    The first ``<base href>`` of the page is what all relative targets are taken on.
    """
    base, told = None, []
    for name, attributes in tags(html):
        if name == "base":
            if base is None and "href" in attributes:
                base = resolve(url, attributes["href"].strip())
        elif (to := target_of(name, attributes)) is not None:
            told.append(to)
    on = base if base is not None and "://" in base else url
    return [resolve(on, to) for to in told]


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)``: page and the targets of its canonical links and of its refreshes.

    Relative targets are taken on the page's base, or its own address; addresses without ``://``, null
    pages and null urls give no edge.
    """

    @F.arrow_udf("array<string>")
    def targets(url: pa.Array, html: pa.Array) -> pa.Array:
        return pa.array([targets_of(u.as_py(), h.as_py()) for u, h in zip(url, html)], pa.list_(pa.string()))

    url, html = F.col(url_col), F.col(html_col)
    some = pages.where(html.rlike(r"(?i)<(?:link|meta)[\s/]") & F.contains(url, F.lit("://"))).select(url.alias("url"), html.alias("html"))
    full = some.select("url", F.explode(targets("url", "html")).alias("full"))
    return full.select(_node(F.col("url")).alias("a"), _node(F.col("full")).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict.

    A page without a rule is allowed unless its component is blocked; a component that holds an
    explicit allow is not. A link's target takes part with the rule that its own address has, even
    if it is no page of the table. Null urls and urls without ``://`` have no host, path or rule, and
    are allowed. Repeated pages are judged alike. Other columns are not read.
    """
    edges = checkpoint(alias_edges(pages, url_col, html_col).distinct())
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    thin = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), _node(F.col(url_col)).alias("node"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    thin = thin.select("page_id", "host", "path", "node", rule.alias("rule"), verdict.alias("own"))
    members = connected_components(edges)
    of_node = match_rule(F.regexp_extract("node", r"(?s)\A([^/?]*)", 1), F.regexp_extract("node", r"(?s)\A[^/?]*([^?]*)", 1), rules)[1]
    marks = members.withColumn("own", of_node).groupBy("component").agg(F.max(F.col("own") == "allow").alias("a"), F.max(F.col("own") == "block").alias("b"))
    blocked = members.join(marks.where("b and not coalesce(a, false)"), "component").select("node", F.lit("block").alias("shared"))
    told = thin.join(blocked, "node", "left")
    return told.select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
t AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  host || path || regexp_extract(coalesce(url, ''), '^[^?#]*(\?[^#]*)', 1) AS node,
  regexp_extract(url, '^(?s:.*?)://[^/?#]*', 0) AS base,
  regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g') AS html FROM p),
g AS (SELECT node, base, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM t WHERE html ILIKE '%canonical%' OR html ILIKE '%refresh%'),
f AS (SELECT node, base, replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*(["'']?)([^"''>]*\s)?canonical["''\s/>]') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh["''\s/>]') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS c FROM g),
e AS (SELECT node AS a, regexp_replace(CASE WHEN starts_with(c, '/') THEN base || c ELSE c END, '^(?s:.*?)://', '') AS b FROM f WHERE c <> ''),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT x, b FROM reach JOIN both_ways ON y = a),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS own FROM t),
m AS (SELECT x, bool_or(own = 'block') AS b, bool_or(own = 'allow') AS a FROM reach JOIN v ON v.node = y GROUP BY x)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN m.b AND NOT coalesce(m.a, false) THEN 'block' END, 'allow') AS verdict
FROM v LEFT JOIN m ON v.node = m.x
"""
