"""URL filters with redirect equivalence.

Rules judge a url by its host and path. A url that no rule fits takes the decision of its aliases:
urls joined by canonical links, meta refreshes and og:url, and spellings of one address (scheme, default
port, fragment, empty path). Aliases form distributed connected components. A component with a blocked
member blocks its undecided members, unless it has a member that a rule allows explicitly: an explicit
allow takes precedence, on the url itself and among its aliases. Without any evidence a url is allowed.
Addresses are named by 64-bit hashes, proven to stand for one address each.

Null urls and urls without :// have an empty host and path and no aliases; null html has no links;
repeated rows are judged alike; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import materialise, quoted
from inkfield.llm.components import components

#: (verdict, host, path) of the query's contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """One spelling for all urls that name the same address; null if it is none."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def links(url: Column, html: Column) -> Column:
    """Absolute targets that a page's head names as another address of itself. The head ends at its end tag or, where
    tags are left out, at the first element that no head holds; comments, scripts, styles and titles hold no tags."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", ""), r"(?is)<(script|style|title)\b.*?(?:</\1\s*>|\z)", "")
    head = F.regexp_replace(plain, r"(?is)(?:</head\b|<(?!(?:html|head|meta|link|base|noscript|template)\b)[a-z]).*", "")
    tags = F.regexp_extract_all(head, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))

    def target(tag: Column) -> Column:
        href = F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
        refresh = F.regexp_extract(tag, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)
        content = F.regexp_extract(tag, r"(?i)\bcontent\s*=\s*[\"']?([^\"'\s>]+)", 1)
        return (
            F.when(tag.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), href)
            .when(tag.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), refresh)
            .when(tag.rlike(r"(?i)\bproperty\s*=\s*[\"']?og:url\b"), content)
        )

    def absolute(t: Column) -> Column:
        t = F.replace(t, F.lit("&amp;"), F.lit("&"))
        folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
        return (
            F.when(t.contains("://"), t)
            .when(t.startswith("//"), F.concat(F.lit("http:"), t))
            .when(t.startswith("/"), F.concat(F.lit("http://"), host_of(url), t))
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#"), None)
            .otherwise(F.concat(F.lit("http://"), host_of(url), F.when(folder == "", "/").otherwise(folder), t))
        )

    found = F.filter(F.transform(tags, target), lambda t: t.isNotNull() & (t != ""))
    return F.filter(F.transform(found, absolute), lambda t: t.isNotNull())


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    u = F.col(quoted(url))
    host, path = host_of(u), path_of(u)
    rule, own = match(host, path, rules)
    thin = materialise(
        pages.select(
            F.col(quoted(page_id)).alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), own.alias("own"),
            address(u).alias("address"), (host != "").alias("named"), links(u, F.col(quoted(html))).alias("links"),
        ),
        "urls",
    )
    ends = thin.filter("named").select("address", F.explode("links").alias("link")).withColumn("target", address(F.col("link")))
    ends = materialise(ends.filter("target is not null").distinct(), "links")
    every = thin.filter("named").select("address").unionByName(ends.select(F.col("target").alias("address"))).distinct()
    seed = 0
    while not every.groupBy(F.xxhash64(F.lit(seed), "address").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        seed += 1  # a name stood for two addresses: others are drawn
    name = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    thin = thin.withColumn("node", name("address"))
    edges = ends.select(name("address").alias("node"), name("target").alias("other"), "link")
    group = components(edges, "node", "other")
    # what rules say of every address, pages' and targets'
    _, of_target = match(host_of(F.col("link")), path_of(F.col("link")), rules)
    said = thin.filter("named").select("node", F.col("own").alias("said")).unionByName(edges.select(F.col("other").alias("node"), of_target.alias("said")))
    said = said.filter("said is not null").distinct().join(group, "node", "left")
    members = said.groupBy(F.coalesce("component", "node").alias("class")).agg(F.max(F.col("said") == "block").alias("block"), F.max(F.col("said") == "allow").alias("allow"))
    blocked = members.filter("block and not allow").select("class")
    in_group = blocked.join(group, blocked["class"] == group["component"]).select("node")
    bad = in_group.unionByName(blocked.select(F.col("class").alias("node"))).distinct().withColumn("bad", F.lit(True))
    undecided = thin.filter("own is null").select("page_id", "host", "path", "rule", "named", "node").join(bad, "node", "left")
    decided = thin.filter("own is not null").select("page_id", "host", "path", "rule", F.col("own").alias("verdict"))
    return decided.unionByName(
        undecided.select("page_id", "host", "path", "rule", F.when(F.col("bad") & F.col("named"), "block").otherwise("allow").alias("verdict"))
    )
