"""URL filters: explicit host and path rules, then redirect equivalence.

A url without a rule of its own takes the decision of its aliases: urls joined
by redirects (meta refresh, a table of redirects) or canonical links.
Components over these edges are found distributed; one that holds a blocked
url is blocked, but an explicit allow rule stands.

Urls that differ in the case of scheme or host or in the fragment are one
vertex.  As an option, so are those that differ only in scheme, ``www.``,
tracking parameters or a closing slash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.llm.common import lower_ascii, rows_of, sealed, stage
from solvefront.llm.components import connected_components

Rule = tuple[str, str, str]  # host, path, verdict
#: The target of a refresh: after its seconds and ``url=``, quoted or to the end.
REFRESH_TARGET = re.compile(r"""\s*[0-9.]*\s*[;,]?\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)
PARSE_BYTES = 4 << 20
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def vertex(url: Column) -> Column:
    """The url with scheme and host in lower case and without fragment; null where there is no ``://``."""
    rest = F.regexp_extract(_after(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(lower_ascii(F.regexp_extract(url, r"^(.*?)://", 1)), F.lit("://"), host_of(url), rest))


def alias_key(url: Column) -> Column:
    """What urls that are trivially the same page share; null where there is no ``://``."""
    query = F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_|ref=)")), "&")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    tail = F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))
    return F.when(F.locate("://", url) > 0, F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), tail))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.

    A rule fits its host and all subdomains where the path starts with the
    rule's path.  Rules are configuration: they become a literal map from host
    to its rules, looked up by each suffix of the host, without a shuffle.
    """
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule[0], []).append(rule)
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    known = F.create_map(*[x for h, rs in by_host.items() for x in (
        F.lit(h), F.array(*[F.struct(F.lit(len(h + p)).alias("n"), F.lit(v == "allow").alias("allow"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for _, p, v in rs]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(closed, "/")).otherwise(path)


def absolute(href: Column, base: Column) -> Column:
    """The link as seen from ``base``: absolute only if a scheme leads it; else by host, by path, by query, or beside the page."""
    scheme = F.concat(F.regexp_extract(base, r"^(.*?)://", 1), F.lit("://"))
    root = F.concat(scheme, host_of(base))
    page = F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base))
    folder = F.regexp_extract(page, r"^(.*/)[^/]*$", 1)
    path, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike(SCHEME), F.when(href.rlike(SCHEME + "//"), href))
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^(.*?:)//", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, without_dots(path), rest))
        .when(F.startswith(href, F.lit("?")), F.concat(root, page, href))
        .when(F.startswith(href, F.lit("#")), base)
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), rest))
    )


class LinkParser(HTMLParser):
    """Canonical links, refreshes and the first base of a page, in document order.

    Comments, scripts, styles and the texts of titles and text areas hold no
    tags.  Attributes are read whole, by name; of a repeated one the first
    counts; values have their entities decoded.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base: str | None = None
        self.found: list[str] = []
        self.inside: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.inside:
            return
        if tag in ("title", "textarea"):
            self.inside = tag
            return
        if tag not in ("base", "link", "meta"):
            return
        said: dict[str, str] = {}
        for name, value in attrs:
            said.setdefault(name, value or "")
        href = said.get("href", "").strip(" \t\n\r\f")
        if tag == "base" and href and self.base is None:
            self.base = href
        elif tag == "link" and href and "canonical" in said.get("rel", "").lower().split():
            self.found.append(href)
        elif tag == "meta" and said.get("http-equiv", "").strip().lower() == "refresh":
            target = next((g for g in REFRESH_TARGET.match(said.get("content", "")).groups() if g), "").strip(" \t\n\r\f")
            if target:
                self.found.append(target)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in ("title", "textarea"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == self.inside:
            self.inside = None


def page_links(html: str) -> tuple[str | None, list[str]]:
    """(base, links) of a page, links once each."""
    parser = LinkParser()
    parser.feed(html)
    parser.close()
    return parser.base, list(dict.fromkeys(parser.found))


def linked(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(page, base, link), a row for each link; pages are parsed in Arrow batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "html", PARSE_BYTES):
            rows = [(u, base, link) for u, (base, links) in ((u, page_links(h)) for u, h in zip(batch.column("page").to_pylist(), batch.column("html").to_pylist(), strict=True)) for link in links]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["page", "base", "link"])

    return pages.select(F.col(url).alias("page"), F.col(html).alias("html")).mapInArrow(work, "page string, base string, link string")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(a_url, b_url): all canonical links and meta refreshes of the pages, resolved against the page's base, and ``redirects`` (from_url, to_url)."""
    links = linked(pages.where(F.col(html).rlike("(?i)canonical|refresh") & F.contains(F.col(url), F.lit("://"))), url, html)
    based = links.withColumn("base", F.coalesce(absolute(F.col("base"), F.col("page")), F.col("page")))
    edges = based.select(F.col("page").alias("a_url"), absolute(F.col("link"), F.col("base")).alias("b_url")).where("b_url is not null").distinct()
    return edges.union(redirects.select("from_url", "to_url")) if redirects is not None else edges


def filter_urls(spark: SparkSession, pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", html: str = "html", redirects: DataFrame | None = None, default: str = "allow", trivial_aliases: bool = False) -> DataFrame:
    """Add host, path, rule and verdict to each page.

    Null urls and urls without ``://`` have empty host and path, no rule and
    no alias: the default.  Null html has no links.  Repeated pages get equal
    verdicts; an empty table stays empty; columns of these names are replaced.
    ``trivial_aliases`` takes urls with one :func:`alias_key` for one vertex.
    """
    key = alias_key if trivial_aliases else vertex
    made = ("host", "path", "rule", "verdict")
    box = sealed(pages.drop(*[c for c in made if c not in (url, html)]))
    rest, names = box.df, [c for c in box.names if c not in made]
    url, html = box.name(url), box.name(html)
    edges = alias_edges(rest, url, html, redirects)
    pairs = stage(spark, edges.select("a_url", "b_url", key(F.col("a_url")).alias("a"), key(F.col("b_url")).alias("b")), "alias-edges")
    roots = connected_components(spark, pairs, "a", "b", name="aliases")
    ends = pairs.select(F.col("a_url").alias("_u")).union(pairs.select("b_url"))
    every = rest.select(F.col(url).alias("_u")).union(ends)
    blocked_keys = every.where(match_rule(host_of(F.col("_u")), path_of(F.col("_u")), rules)["verdict"] == "block").select(key(F.col("_u")).alias("_k")).distinct()
    blocked_roots = blocked_keys.join(roots, blocked_keys["_k"] == roots["vertex"], "left").select(F.coalesce("root", "_k").alias("_r")).distinct()
    # All vertices of blocked components, the vertex itself where it has no edge; those that a rule decides need no entry.
    spread = blocked_roots.join(roots, blocked_roots["_r"] == roots["root"], "left").select(F.coalesce("vertex", "_r").alias("_blocked")).distinct()
    spread = stage(spark, spread, "blocked")
    judged = rest.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "_key": key(F.col(url))})
    judged = judged.withColumn("_rule", match_rule(F.col("host"), F.col("path"), rules))
    out = judged.join(spread, F.col("_key") == F.col("_blocked"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked").isNotNull(), F.lit("block")), F.lit(default))
    kept = [F.col(box.name(c)).alias(c) for c in names]
    return out.select(*kept, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


#: The rules of the registered query.
QUERY_RULES: tuple[Rule, ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

ORACLE = r"""
WITH RECURSIVE rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
clean AS (
  SELECT DISTINCT url, regexp_replace(html, '(?is)<!--.*?(-->|$)|<script\b.*?(</script[^>]*>|$)|<style\b.*?(</style[^>]*>|$)|<title\b.*?(</title[^>]*>|$)|<textarea\b.*?(</textarea[^>]*>|$)', ' ', 'g') AS html
  FROM pages WHERE instr(url, '://') > 0 AND regexp_matches(html, '(?i)canonical|refresh')),
tags AS (
  SELECT url, t.i, t.tag, regexp_extract_all(t.tag, '([^\s"''<>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS names,
    regexp_extract_all(t.tag, '([^\s"''<>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 2) AS vals
  FROM (SELECT url, unnest(list_transform(regexp_extract_all(html, '(?is)<(?:base|link|meta)[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>'), lambda x, i: {'i': i, 'tag': x})) AS t FROM clean)),
said AS (
  SELECT url, i, lower(regexp_extract(tag, '^<(\w+)', 1)) AS kind,
    list_transform(['href', 'rel', 'http-equiv', 'content'], lambda k: vals[list_position(list_transform(names, lambda n: lower(n)), k)]) AS v FROM tags),
bare AS (
  SELECT url, i, kind, list_transform(v, lambda x: trim(replace(replace(replace(replace(replace(
    CASE WHEN regexp_matches(x, '^["'']') THEN x[2:-2] ELSE x END, '&#39;', chr(39)), '&quot;', '"'), '&#x2F;', '/'), '&#47;', '/'), '&amp;', '&'))) AS v FROM said),
based AS (SELECT url, arg_min(v[1], i) AS base_href FROM bare WHERE kind = 'base' AND v[1] <> '' GROUP BY 1),
links AS (
  SELECT url, v[1] AS raw FROM bare WHERE kind = 'link' AND list_contains(regexp_split_to_array(lower(v[2]), '\s+'), 'canonical')
  UNION ALL
  SELECT url, regexp_extract(regexp_replace(v[4], '(?is)^\s*[0-9.]*\s*[;,]?\s*(url\s*=\s*)?', ''), '(?s)^(?:["'']([^"'']*)|)', 1)
    || CASE WHEN regexp_matches(regexp_replace(v[4], '(?is)^\s*[0-9.]*\s*[;,]?\s*(url\s*=\s*)?', ''), '^["'']') THEN '' ELSE regexp_replace(v[4], '(?is)^\s*[0-9.]*\s*[;,]?\s*(url\s*=\s*)?', '') END
  FROM bare WHERE kind = 'meta' AND lower(v[3]) = 'refresh'),
seen AS (
  SELECT links.url AS page, raw AS href, CASE
    WHEN base_href IS NULL THEN links.url
    WHEN regexp_matches(base_href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN base_href
    WHEN starts_with(base_href, '//') THEN regexp_extract(links.url, '^(.*?:)//', 1) || base_href
    WHEN starts_with(base_href, '/') THEN regexp_extract(links.url, '^.*?://[^/?#]*', 0) || base_href
    ELSE regexp_extract(links.url, '^.*?://[^/?#]*', 0) || regexp_replace(COALESCE(NULLIF(regexp_extract(links.url, '^.*?://[^/?#]*([^?#]*)', 1), ''), '/'), '[^/]*$', '') || base_href END AS base
  FROM links LEFT JOIN based ON based.url = links.url),
hrefs AS (SELECT page, base, href,
    regexp_extract(base, '^(.*?)://', 1) AS scheme, regexp_extract(base, '^.*?://([^/?#]*)', 1) AS site,
    regexp_replace(COALESCE(NULLIF(regexp_extract(base, '^.*?://[^/?#]*([^?#]*)', 1), ''), '/'), '[^/]*$', '') AS folder FROM seen WHERE href <> ''),
edges AS (SELECT page AS a_url, CASE
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(href, '//') THEN scheme || ':' || href
    WHEN starts_with(href, '/') THEN scheme || '://' || site || href
    WHEN starts_with(href, '?') OR starts_with(href, '#') THEN split_part(split_part(base, '#', 1), '?', 1) || href
    ELSE scheme || '://' || site || folder || href END AS b_url FROM hrefs),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT a_url FROM edges UNION ALL SELECT b_url FROM edges)),
cut AS (SELECT url, substr(url, 1, instr(url, '://') - 1) AS scheme, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM urls),
parts AS (
  SELECT url, scheme, rest, COALESCE(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    COALESCE(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
keyed AS (
  SELECT url, host, path, CASE WHEN rest IS NOT NULL THEN lower(scheme) || '://' || host || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS k,
    (SELECT max(row(length(h || p), v = 'allow', h || p, v)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r FROM parts),
joined AS (SELECT x.k AS a, y.k AS b FROM edges e JOIN keyed x ON x.url = a_url JOIN keyed y ON y.url = b_url),
reach(k) AS (SELECT k FROM keyed WHERE r[4] = 'block' UNION SELECT CASE WHEN a = k THEN b ELSE a END FROM reach JOIN joined ON a = k OR b = k)
SELECT page_id, COALESCE(host, '') AS host, COALESCE(path, '') AS path, r[3] AS rule,
  COALESCE(r[4], CASE WHEN keyed.k IN (SELECT k FROM reach WHERE k IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN keyed ON pages.url IS NOT DISTINCT FROM keyed.url
"""
