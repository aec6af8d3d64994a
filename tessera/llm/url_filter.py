"""URL filters that follow redirects: a decision on one address holds for all its aliases.

Edges join a page's address with the targets of all its canonical links and refresh redirects
(found in the html), and addresses that differ only in what doesn't name a page: scheme, ``www.``
and ``m.``, default ports, fragments, tracking parameters and a trailing slash.  Connected
components over these edges are the equivalence classes.  Rules are a table (kind, pattern,
decision): kind ``host`` matches a host and its subdomains, kind ``part`` a part of the host;
decision is ``allow`` or ``block``.  An explicit allow anywhere in a class wins over every block in it.

Defined results
* null, empty or unparsable url: its own class; decided ``keep``, null host.
* null html: no edges.  A target that isn't in ``pages`` still carries decisions on.  Links in comments
  count nothing, nor do targets that aren't http(s).  Targets are resolved as a browser does: dot
  segments, ``?query`` and ``//host`` included; a base element isn't looked at.
* repeated rows: each gets the decision.  Ties can't occur.
* a long redirect chain, also a circle: one class.  Html of any length is searched whole.
* empty table: empty result.  No rules: all are kept.  Ids may be of any type.  Extra columns aren't read,
  whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_side, table
from .components import components

#: Hosts (with their subdomains) and host parts that are blocked; hosts that are allowed come first.
BLOCK_HOSTS = ("doubleclick.net", "malware.test", "phishing.test")
BLOCK_PARTS = ("casino", "free-bets", "cheap-pills", "porn", "xxx", "warez", "payday-loan")
ALLOW_HOSTS = ("casino-history.example.org", "archive.example.org")
TRACKING = r"utm_[a-z]+|gclid|fbclid|ref|mc_cid|mc_eid"

#: Parts of hosts are matched by one expression of all of them; hosts are joined and may be any number.
MOST_PARTS = 10_000

_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*(?:"[^">]*?(?<![\w-])|'[^'>]*?(?<![\w-])|)canonical\b)[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*?\bcontent\s*=\s*["']?[^>]*?\burl\s*=\s*['"]?\s*([^"'\s>]+)"""


def _without_dots(path: Column) -> Column:
    """The path without segments ``.`` and ``..``."""
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(s)))
    return F.when(path.contains("/."), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")).otherwise(path)


def normal(url: Column) -> Column:
    """The address without what doesn't name a page; null if it isn't an http(s) address."""
    clean = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(clean, r"(?i)^https?://(?:[^/?@]*@)?([^/?:]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^(?:www|m)\.", "")
    port = F.regexp_extract(clean, r"(?i)^https?://[^/?]*?:(\d+)(?:[/?]|$)", 1)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(_without_dots(F.regexp_extract(clean, r"(?i)^https?://[^/?]+([^?]*)", 1)), r"/+$", "")
    params = F.split(F.regexp_extract(clean, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(params, lambda p: (p != "") & ~p.rlike(rf"(?i)^(?:{TRACKING})(?:=|$)")))
    query_ = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, port, path, query_))


def absolute(target: Column, base: Column) -> Column:
    """``target`` as seen from the page at ``base``."""
    target = F.regexp_replace(target, "&amp;", "&")
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.concat(root, F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"(?i)^https?://[^/?#]+(/(?:.*/)?)?", 1))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(target.rlike(r"(?i)^https?://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("#"), base)
        .when(target.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target != "", F.concat(folder, target))
    )


def redirects(pages: DataFrame) -> DataFrame:
    """(u, v): normal addresses of pages and of what they point to."""
    low = F.lower("html")
    none = F.array().cast("array<string>")
    shown = F.regexp_replace("html", _COMMENT, " ")
    canonical = F.when(low.contains("canonical"), F.regexp_extract_all(shown, F.lit(_CANONICAL), F.lit(1))).otherwise(none)
    refresh = F.when(low.contains("http-equiv"), F.regexp_extract_all(shown, F.lit(_REFRESH), F.lit(1))).otherwise(none)
    found = pages.filter("url is not null and html is not null").select("url", F.explode(F.concat(canonical, refresh)).alias("target"))
    found = found.filter("target is not null and target <> ''")
    return found.select(normal(F.col("url")).alias("u"), normal(absolute(F.col("target"), F.col("url"))).alias("v")).filter("u is not null and v is not null and u <> v").distinct()


def host_of(address: Column) -> Column:
    return F.regexp_extract(address, r"^([^/?:]+)", 1)


def default_rules(spark: SparkSession) -> DataFrame:
    """A few rules, to be replaced by lists of one's own."""
    rows = [("host", h, "block") for h in BLOCK_HOSTS] + [("part", p, "block") for p in BLOCK_PARTS] + [("host", h, "allow") for h in ALLOW_HOSTS]
    return spark.createDataFrame(rows, "kind string, pattern string, decision string")


def ruled_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, allowed, blocked) of the hosts that a rule matches."""
    rules = cut(rules.select("kind", F.lower("pattern").alias("pattern"), "decision").filter("pattern <> ''").distinct())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = hosts.filter("host <> ''").distinct()
    by_host = hosts.select("host", F.explode(suffixes).alias("pattern")).join(small_side(rules.filter("kind = 'host'")), "pattern").select("host", "decision")
    found = by_host
    for decision in ("allow", "block"):
        parts = [r[0] for r in rules.filter((F.col("kind") == "part") & (F.col("decision") == decision)).select("pattern").limit(MOST_PARTS + 1).collect()]
        if len(parts) > MOST_PARTS:
            raise ValueError(f"more than {MOST_PARTS} rules of kind part")
        if parts:
            found = found.unionByName(hosts.filter(F.col("host").rlike("|".join(map(re.escape, sorted(parts))))).select("host", F.lit(decision).alias("decision")))
    return found.groupBy("host").agg(F.max(F.col("decision") == "allow").alias("allowed"), F.max(F.col("decision") == "block").alias("blocked"))


def decide(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(page_id, url, address, class, decision): decision is allow, block or keep."""
    edges = cut(redirects(pages))
    group_of = cut(components(edges))
    nodes = pages.select(normal(F.col("url")).alias("node")).filter("node is not null").unionByName(group_of.select("node")).distinct()
    nodes = cut(nodes.withColumn("host", host_of(F.col("node"))))
    ruled = cut(ruled_hosts(nodes.select("host"), default_rules(pages.sparkSession) if rules is None else rules))
    group_of = small_side(group_of)
    verdicts = (
        nodes.join(small_side(ruled), "host")
        .join(group_of, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("class"))
        .agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
        .select("class", F.when(F.col("allowed"), "allow").otherwise("block").alias("verdict"))
    )
    addressed = pages.select("page_id", "url", normal(F.col("url")).alias("address"))
    classed = addressed.join(group_of, F.col("address") == F.col("node"), "left").select("page_id", "url", "address", F.coalesce("component", "address").alias("class"))
    return classed.join(verdicts, "class", "left").select("page_id", "url", "address", "class", F.coalesce("verdict", F.lit("keep")).alias("decision"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "pages"))
