"""URL filters with redirect equivalence.

Rules block or allow a host with its subdomains and a path below it. Pages that
redirect to one another, or name one another as their canonical page, are aliases:
connected components over those links carry a block from one alias to the others,
so a blocked page isn't let in under another name. A rule that fits a URL itself
comes first, so what is allowed explicitly stays allowed among blocked aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.revisits import canonical_url
from gleaner.llm.storage import Workspace, join_checked
from gleaner.operators.components import connected_components

#: (action, host, path) of the rules that the query applies.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rows of rules, labels or decisions that are broadcast at most; more are shuffled.
MOST_BROADCAST_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lowered and the path; both empty without ``://`` or for null."""
    whole = F.contains(url, F.lit("://"))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(whole, host).otherwise(""), F.when(whole, path).otherwise("")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, quoted or not; empty if it isn't there."""
    pattern = rf"(?is)[\s\"'/]{name}{_VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def resolve(base: Column, target: Column) -> Column:
    """``target`` as an absolute URL seen from the page ``base``; null if it can't be."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    found = (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(site == "", F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.rlike(r"^[?]"), F.concat(site, path, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )
    return F.when((target != "") & ~target.startswith("#"), found)


def page_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) of the canonical links and refresh redirects of pages.

    Both stand in the page's markup: ``<link rel="canonical" href=...>`` and
    ``<meta http-equiv="refresh" content="0; url=...">``. Comments and scripts are
    not looked at, nor are targets that no URL can be made of. A page without url or
    html gives no row; links of a page to itself are given too.
    """
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where("url is not null and html is not null")
    rows = rows.where(F.col("html").rlike("(?i)canonical|refresh"))
    tags = rows.select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_TAG), F.lit(0))).alias("tag"))
    canonical = F.when(F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(F.lower(attribute(F.col("tag"), "rel")), r"\s+"), "canonical"), attribute(F.col("tag"), "href"))
    content = attribute(F.col("tag"), "content")
    jump = F.regexp_extract(content, r"(?is)^\s*[0-9.]+\s*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1)
    refresh = F.when(F.col("tag").rlike("(?i)^<meta") & (F.lower(attribute(F.col("tag"), "http-equiv")) == "refresh"), jump)
    found = tags.select("url", resolve(F.col("url"), F.coalesce(canonical, refresh)).alias("target"))
    return found.where("target is not null")


def rule_of(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, action) of the distinct ``urls`` that a rule fits.

    Of several the longest (host and path together) wins; of equally long ones one
    that allows, then that with the longer host. Only as many last labels of a host
    are looked up as the rules' hosts have at most.
    """
    depth = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    host, path = host_and_path(F.col("url"))
    rows = urls.select("url", host.alias("host"), path.alias("path")).where("host <> ''")
    if not depth:
        return rows.select("url", F.lit("").alias("rule"), F.lit("").alias("action")).limit(0)
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, depth + 1)]))
    tried = rows.withColumn("rule_host", F.explode(ends))
    fits = join_checked(tried, rules, "rule_host", "inner", MOST_BROADCAST_ROWS).where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(rule.alias("rule"), "action"), F.struct(F.length(rule), F.col("action") == "allow", F.length("rule_host")))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.action")


def filter_urls(pages: DataFrame, links: DataFrame, rules, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: its id, host, path, rule, verdict and
    class_blocked (a rule blocks a URL of its class).

    ``links`` has url and target, in any direction; ``rules`` are (action, host,
    path) tuples or a DataFrame of those columns, action 'allow' or 'block', other
    rows ignored; hosts are lowered. A rule fits its host and all subdomains where
    the path starts with its own. The verdict is that of the page's longest rule.
    Without one it is 'block' where a URL that a rule blocks is an alias, and else
    'allow'; allowing rules don't spread, nor do blocks past a page's own rule.

    Aliases are URLs that links connect, through any number of steps, and those of
    one canonical form (scheme, www, fragment and tracking parameters apart); targets
    count though they are no pages. Null and malformed URLs have empty host and path,
    fit no rule, and null ones have no alias. Repeated pages get a row each; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    space = Workspace(spark, "urls")
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "action string, host string, path string")
    table = table.where("action in ('allow', 'block') and host is not null and path is not null")
    table = space.keep(table.select("action", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path")).distinct(), "rules")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    edges = space.keep(links.select("url", "target").distinct(), "links")
    urls = rows.select("url").union(edges.select("target")).where("url is not null").distinct()
    urls = space.keep(urls.select("url", canonical_url(F.col("url")).alias("node")), "nodes")
    ruled = space.keep(rule_of(urls, table), "ruled")
    judged = space.keep(urls.join(ruled, "url", "left"), "judged")

    a, b = canonical_url(F.col("url")), canonical_url(F.col("target"))
    pairs = space.keep(edges.select(a.alias("a"), b.alias("b")).where("a <> b").distinct(), "edges")
    labels = space.keep(connected_components(pairs), "labels").select(F.col("node"), "component")
    classed = join_checked(judged, labels, "node", "left", MOST_BROADCAST_ROWS).withColumn("class", F.coalesce("component", "node"))
    classed = space.keep(classed.select("url", "class", "rule", "action"), "classed")
    blocked = space.keep(classed.where("action = 'block'").select("class").distinct().withColumn("alias", F.lit(True)), "blocked")
    found = join_checked(classed, blocked, "class", "left", MOST_BROADCAST_ROWS)
    found = space.keep(found.select("url", "rule", "action", F.coalesce("alias", F.lit(False)).alias("alias")), "found")

    host, path = host_and_path(F.col("url"))
    out = join_checked(rows, found, "url", "left", MOST_BROADCAST_ROWS)
    verdict = F.coalesce("action", F.when(F.col("alias"), "block"), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), host.alias("host"), path.alias("path"), "rule", verdict.alias("verdict"), F.coalesce("alias", F.lit(False)).alias("class_blocked"))
