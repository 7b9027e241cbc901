"""URL rules and redirect equivalence.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and the longest rule decides.
Pages that redirect to each other, or name the same canonical page, are one: connected components over those links carry
a block to pages that no rule fits, unless a rule allows any page or target of the component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import components
from nearfield.llm.common import settle

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are tried on each row; more are joined by host.
FEW = 64
#: (tag, attribute that it must have, a word that must stand in the page)
CANONICAL = ("link", r"(?i)\brel\s*=\s*[\"']?canonical\b", "canonical")
REFRESH = ("meta", r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b", "refresh")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What makes two URLs one node: host, path and query, without scheme and fragment; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest))


def first_tag(html: Column, tag: str, attribute: str, word: str) -> Column:
    """The first tag of a kind with an attribute, from ``<`` up to ``>``; null if there is none.

    The page is cut at each ``>`` first, so that the time is in proportion to its length, whatever is in it.
    """
    parts = F.split(html, ">")
    closed = F.slice(parts, F.lit(1), F.size(parts) - 1)
    begins = rf"(?i)<{tag}\b"
    tags = F.transform(F.filter(closed, lambda x: x.rlike(begins)), lambda x: F.regexp_replace(x, rf"(?is)^.*?(?=<{tag}\b)", ""))
    return F.when(html.rlike(f"(?i){word}"), F.get(F.filter(tags, lambda x: x.rlike(attribute)), F.lit(0)))


def target_of(url: Column, html: Column) -> Column:
    """The URL a page names as canonical, or else sends its reader to; null if none. Relative ones are completed."""
    link = F.regexp_extract(first_tag(html, *CANONICAL), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    sent = F.regexp_extract(first_tag(html, *REFRESH), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)
    to = F.coalesce(F.nullif(link, F.lit("")), F.nullif(sent, F.lit("")))
    scheme, root = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(root, F.regexp_replace(path_of(url), r"[^/]*$", ""))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(F.contains(to, F.lit("://")), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(root, to))
        .otherwise(F.concat(folder, to))
    )


def _ruled(df: DataFrame, host: str, path: str, rules: tuple, keep: list[str]) -> DataFrame:
    """``keep`` of each row, with rule and rule_verdict of the longest rule that fits, else null. An allow wins a tie."""
    rules = [(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules]
    if len(rules) <= FEW:
        fits = [
            F.when(
                ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p),
                F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(v == "allow").alias("a"), F.lit(h + p).alias("rule"), F.lit(v).alias("rule_verdict")),
            )
            for v, h, p in rules
        ]
        best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,a:boolean,rule:string,rule_verdict:string>")
        return df.select(*keep, best.alias("best")).select(*keep, "best.rule", "best.rule_verdict")
    table = df.sparkSession.createDataFrame([(v, h, p, len(h) + len(p)) for v, h, p in rules], "v string, h string, p string, n int")
    places = df.select(host, path).distinct()
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = (
        places.withColumn("h", F.explode(suffixes))
        .join(table, "h")
        .where(F.startswith(F.col(path), F.col("p")))
        .groupBy(host, path)
        .agg(F.max(F.struct("n", (F.col("v") == "allow").alias("a"), F.concat("h", "p").alias("rule"), F.col("v").alias("rule_verdict"))).alias("best"))
    )
    return df.join(found, [host, path], "left").select(*keep, "best.rule", "best.rule_verdict")


def judge(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each page. ``redirects``: more links, as (url, target).

    A null url or one without ``://`` has no host, path, rule or links, and is allowed; null html has no links; pages
    with the same URL up to scheme and fragment are one node; null or repeated ids and repeated rows are judged each by
    themselves; other columns are not read; an empty table gives no rows.
    """
    url = F.col("url")
    p = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), key_of(url).alias("key"))
    ruled = _ruled(p, "host", "path", rules, ["page_id", "host", "path", "key"])
    links = pages.where(F.contains(url, F.lit("://"))).select("url", target_of(url, F.col("html")).alias("target"))
    if redirects is not None:
        links = links.union(redirects.select("url", "target"))
    links = settle(links.where("target is not null").select(key_of(url).alias("a"), key_of(F.col("target")).alias("b"), "url", "target").where("a != b"))
    plain = F.coalesce(F.col("rule_verdict"), F.lit("allow")).alias("verdict")
    if links.isEmpty():
        return ruled.select("page_id", "host", "path", "rule", plain)
    alias = components(links.select("a", "b"))
    nodes = links.select(F.col("a").alias("key"), url.alias("u")).union(links.select(F.col("b"), F.col("target"))).groupBy("key").agg(F.min("u").alias("u"))
    nodes = _ruled(nodes.select("key", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")), "host", "path", rules, ["key"])
    member = settle(nodes.join(alias, F.col("key") == F.col("node"), "left").select("key", "rule_verdict", F.coalesce("component", "key").alias("component")))
    verdict = member.groupBy("component").agg(F.bool_or(F.col("rule_verdict") == "block").alias("blocked"), F.bool_or(F.col("rule_verdict") == "allow").alias("allowed"))
    blocked = member.join(verdict, "component").where("blocked and not coalesce(allowed, false)").select(F.col("key").alias("k"), F.lit(True).alias("aliased"))
    return ruled.join(blocked, F.col("key") == F.col("k"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce(F.col("rule_verdict"), F.when(F.col("aliased"), "block"), F.lit("allow")).alias("verdict")
    )
