"""URL rules carried over redirect and canonical-link equivalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

#: (host, path, verdict): a rule fits the host with its subdomains and paths that start with its path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Host labels and query parameters that do not make another page.
ALIAS_LABELS, TRACKING = ("www", "m"), r"utm_[a-z]+|ref|fbclid|gclid"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, or null. One expression, however many urls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered]
    return F.coalesce(*fits)


def canonical_key(url: Column) -> Column:
    """Spellings of one page to one key: scheme, fragment, alias host labels, tracking parameters, ``.html`` and a last slash go. Null without ``://``."""
    host = F.regexp_replace(host_of(url), rf"^(?:{'|'.join(ALIAS_LABELS)})\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/index)?\.html?$|/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"^(?:{TRACKING})(?:=|$)")), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    whole = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.slice(whole, 2, F.size(whole)), F.slice(whole, 1, 1), step), "/")


def resolved(link: Column, base: Column) -> Column:
    """A link as a whole url, read from a page at ``base``; null where it names no other page."""
    root, path = F.regexp_extract(base, r"^((?s:.*?)://[^/?#]*)", 1), path_of(base)
    page, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)", 1)
    beside = F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract(path, r"^(.*/)", 1), "^/", ""), page)
    return (
        F.when(link.contains("://"), link).when((root == "") | (link == "") | link.startswith("#") | link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^((?s:.*?):)//", 1), link)).when(link.startswith("?"), F.concat(root, path, link))
        .when(link.startswith("/"), F.concat(root, without_dots(page), rest)).otherwise(F.concat(root, without_dots(beside), rest))
    )


def html_links(html: Column, url: Column) -> Column:
    """Targets of all canonical links, ``og:url`` properties and meta refreshes of a page as whole urls; relative ones start at its ``base``, if it has one."""
    attr = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'\s>]+)", 1)
    says = lambda tag, kind, name, value: tag.rlike(rf"(?is)^<{kind}\b.*\b{name}\s*=\s*[\"']?{value}(?![\w-])")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), F.lit(0))
    target = lambda t: (
        F.when(says(t, "link", "rel", "canonical"), attr(t, "href")).when(says(t, "meta", "property", "og:url"), attr(t, "content"))
        .when(says(t, "meta", "http-equiv", "refresh"), F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    )
    base = F.coalesce(resolved(attr(F.get(F.filter(tags, lambda t: t.rlike(r"(?is)^<base\b")), 0), "href"), url), url)
    # The base is bound once, as a lambda's argument, however many links read it.
    found = F.transform(F.array(base), lambda b: F.transform(tags, lambda t: F.transform(F.array(target(t)), lambda x: resolved(x, b))))
    return F.array_distinct(F.array_compact(F.flatten(F.flatten(found))))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(a, b)`` between urls: links found in ``html``, rows ``(from_url, to_url)`` of a redirect log, and every url with its canonical spelling."""
    links = pages.where("html is not null and url like '%://%'").select(F.col("url").alias("a"), F.explode(html_links(F.col("html"), F.col("url"))).alias("b"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b")))
    links = materialize(links.where("a like '%://%' and b like '%://%'").distinct(), "links")
    urls = pages.select("url").unionByName(links.select(F.col("a").alias("url"))).unionByName(links.select(F.col("b").alias("url")))
    spelled = urls.where("url like '%://%'").distinct().select(F.col("url").alias("a"), canonical_key(F.col("url")).alias("b"))
    return links.unionByName(spelled)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, url, html)`` to ``(page_id, url, host, path, rule, verdict, component, decided)``.

    A page with a fitting rule has that rule's verdict. The others take the block of any alias in
    their component of redirects, canonical links and spellings, unless the component also holds an explicitly
    allowed url; without either they are allowed. Aliases count whether or not they are pages of the
    table: a rule that fits the target of a redirect is passed on to what redirects there. ``component`` is
    the least url or canonical spelling (which has no scheme) of the component; ``decided`` is ``rule``, ``alias`` or ``none``.

    What a component holds is two flags, combined before the shuffle. Null urls and those without ``://`` have empty
    host and path, no rule, no alias, and are allowed. Null html has no links. Repeated rows are judged alike.
    """
    url = F.col("url")
    edges = materialize(alias_edges(pages, redirects), "aliases")
    roots = connected_components(edges)
    known = edges.select(F.col("a").alias("node")).distinct().join(roots, "node")  # canonical spellings are no urls
    known = materialize(known.withColumn("fit", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]), "known")
    flag = lambda v: F.max(F.when(F.col("fit") == v, 1).otherwise(0)).alias(v)
    groups = known.groupBy("root").agg(flag("block"), flag("allow"))
    blocked = known.where("fit is null").join(groups.where("block = 1 and allow = 0"), "root").select("node", F.lit(True).alias("blocked"))
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    out = judged.join(roots.select(F.col("node").alias("url"), F.col("root").alias("component")), "url", "left").join(blocked.withColumnRenamed("node", "url"), "url", "left")
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    decided = F.when(F.col("fit").isNotNull(), "rule").when(F.col("blocked"), "alias").otherwise("none")
    return out.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "component", decided.alias("decided"))
