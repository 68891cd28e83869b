"""URL decisions by rules, carried to aliases over redirects and canonical links.

A URL's own decision is its longest fitting rule's.  URLs that lead to one another form a
component (distributed, see ``operators.components``); a member without a rule of its own
takes the component's decision: allowed if any member is allowed by a rule, else blocked if
any is blocked by one, else allowed.  Edges are what a page states (canonical links and
refresh redirects), redirect records if given, and the URL's own plain spelling, to which
servers redirect: no fragment, no tracking parameters, no closing slash, one scheme, no
``www.``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.components import connected_components
from recordloom.storage import save


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


# The rules of the contract.
RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = r"([?&])(?:(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*(?:&|$))+"


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to a slash, question mark, hash or the end, A-Z lowered."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, a hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host or a domain above it and begins the path; its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def plain(url: Column) -> Column:
    """The spelling that a URL's variants share; null without a host."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, _TRACKING, "$1"), r"[?&]+$", "")
    host, path = F.regexp_replace(host_of(bare), r"^www\.", ""), path_of(bare)
    query = F.regexp_extract(bare, r"(?s)(\?.*)$", 1)
    return F.when(host != "", F.concat(F.lit("//"), host, F.regexp_replace(path, "/+$", ""), query))


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/")
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    return F.array_join(F.aggregate(closed, F.array().cast("array<string>"), step), "/")


def resolved(link: Column, url: Column) -> Column:
    """The absolute target of a link that a page states; null if it leads nowhere else."""
    bare = F.trim(F.regexp_replace(link, "&(?:amp|#38|#[xX]26);", "&"))
    scheme, site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    own, query = path_of(url), F.regexp_extract(bare, r"(?s)([?#].*)$", 1)
    path = F.regexp_extract(bare, r"^([^?#]*)", 1)
    below = F.concat(F.when(own == "", "/").otherwise(F.regexp_replace(own, "[^/]*$", "")), path)
    return (
        F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), bare)
        .when((site == "") | (bare == "") | bare.startswith("#") | bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(bare.startswith("//"), F.concat(scheme, bare))
        .when(bare.startswith("/"), F.concat(site, _without_dots(path), query))
        .when(bare.startswith("?"), F.concat(site, own, query))
        .otherwise(F.concat(site, _without_dots(below), query))
    )


def stated_links(html: Column, url: Column) -> Column:
    """Absolute targets of a page's canonical links and refresh redirects, as an array."""
    text = F.coalesce(html, F.lit(""))
    tags = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)\bcanonical\b|\brefresh\b"))
    targets = F.transform(
        tags,
        lambda t: F.when(t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)).when(
            t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
        ),
    )
    return F.array_compact(F.transform(targets, lambda t: resolved(t, url)))


def verdicts(
    pages: DataFrame, redirects: DataFrame | None = None, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html"
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    Links that pages state may be relative to their URL.  ``redirects``, if given, has absolute URLs ``source`` and ``target``.  A null URL, or one
    without ``://``, has empty host and path, no rule and no aliases, and is allowed; so is
    whatever nothing decides.  Null or repeated ids and repeated rows keep their rows; an
    empty table gives no rows; other columns are not read.
    """
    url = F.col("url")
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), *([stated_links(F.col(html_col), F.col(url_col)).alias("links")] if html_col else []))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = read.withColumns({"host": host_of(url), "path": path_of(url), "node": plain(url)})
    own = save(own.withColumns({"rule": name, "own": verdict}), "urls")
    edges = []
    if html_col:
        edges.append(own.select(F.col("node").alias("a"), F.explode("links").alias("t")).select("a", plain(F.col("t")).alias("b"), F.col("t").alias("to")))
    if redirects is not None:
        edges.append(redirects.select(plain(F.col("source")).alias("a"), plain(F.col("target")).alias("b"), F.col("target").alias("to")))
    own_ruled = own.where("node is not null").select("node", "own")
    if edges:
        links = save(reduce(DataFrame.unionByName, edges).where("a is not null and b is not null"), "redirects")
        # A target decides too, whether or not a page of it is in the table.
        _, target = rule_of(host_of(F.col("to")), path_of(F.col("to")), rules)
        own_ruled = own_ruled.unionByName(links.select(F.col("b").alias("node"), target.alias("own")))
        roots = save(connected_components(links), "roots").select(F.col("node").alias("n"), "root")
        votes = own_ruled.where("own is not null").join(roots, F.col("node") == F.col("n"), "left").select(F.coalesce("root", "node").alias("root"), "own")
    else:
        roots, votes = None, own_ruled.where("own is not null").withColumnRenamed("node", "root")
    # Allowed by any rule comes before blocked by any.
    decided = save(votes.groupBy("root").agg(F.min("own").alias("alias")).withColumnRenamed("root", "r"), "decided")
    # Both may be as many as the pages: joined over shuffles, whatever they seem to hold.
    placed = own
    if roots is not None:
        placed = own.join(roots.hint("merge"), F.col("node") == F.col("n"), "left").withColumn("node", F.coalesce("root", "node"))
    return placed.join(decided.hint("merge"), F.col("node") == F.col("r"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "alias", F.lit("allow")).alias("verdict")
    )
