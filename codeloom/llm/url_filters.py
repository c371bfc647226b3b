"""Operator 10: URL filters with redirect equivalence, in DataFrame operations only.

Rules (host, path, action) fit a host and its subdomains where the url's path starts with the rule's; the longest
fitting rule (host and path together; on a tie allow) gives a verdict. Pages without a rule take the verdict of
their redirect class: edges run from a page's url to its canonical link and its refresh target, and connected
components make classes. In a class, an explicit allow outranks every block, a block outranks none, and
a class that no rule touches is allowed.

Cases: a null url, or one without "://", has empty host and path, fits no rule and joins no class, so it is allowed;
null or empty html has no edges; very long html is searched whole; equal rows each give a row and equal urls are one node; relative
links follow the page's url (a base element isn't read, and dot segments count where a link begins with them); an empty table gives an
empty result; only the id, url and html columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import looked_up
from .components import components

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Character references of urls that are decoded, the ampersand's own last.
REFERENCES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&#60;", "<"), ("&gt;", ">"), ("&#62;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#58;", ":"), ("&#x3a;", ":"), ("&#x3A;", ":"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def resolved(base: Column, to: Column) -> Column:
    """An absolute url of a link on a page, by the base's scheme, host, or folder; leading dot segments climb. Null for links to a place
    in the same page, and for those whose scheme has no host."""
    origin, whole = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.split(F.regexp_extract(base, r"(?s)^.*?://[^/?#]*((?:/[^?#/]*)*)/", 1), "/")
    lead = F.regexp_extract(to, r"^((?:\.{1,2}/)*)", 1)
    up = ((F.length(lead) - F.length(F.replace(lead, F.lit("../"), F.lit("")))) / 3).cast("int")
    kept = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.lit(1), F.size(folder) - up)), "/")
    rest = F.substr(to, F.length(lead) + 1, F.length(to))
    return (
        F.when(to.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.when(to.contains("://"), to))
        .when(to.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(origin, to))
        .when(to.startswith("?"), F.concat(whole, to))
        .when(to.startswith("#") | (to == ""), F.lit(None))
        .otherwise(F.concat(origin, kept, F.lit("/"), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v) urls: canonical links and refresh redirects that a page states in its html."""
    html = F.col("html")
    tags = F.expr(r"regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>', 0)")
    some = pages.where(F.col("url").contains("://") & html.rlike(r"(?is)<link\b[^>]*\bcanonical\b|<meta\b[^>]*\brefresh\b"))
    tag = some.select("url", F.explode(tags).alias("tag"))
    rel = r"""(?is)^<link\b.*\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?:[\s/>]))"""
    canonical = F.when(F.col("tag").rlike(rel), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+(?:;[^\"'\s>]+)*)", 1))
    to = F.coalesce(canonical, refresh)
    for written_as, char in REFERENCES:
        to = F.replace(to, F.lit(written_as), F.lit(char))
    found = tag.select("url", to.alias("to")).where("to is not null")
    return found.select(F.col("url").alias("u"), resolved(F.col("url"), F.col("to")).alias("v")).where("v is not null and u != v")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each distinct host the rules of it and of the domains above it, found by an equi-join."""
    parts = F.split("host", r"\.")
    above = hosts.where("host != ''").select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))).alias("rule_host"))
    named = rules.select(F.col("host").alias("rule_host"), F.struct(F.length(F.concat("host", "path")).alias("size"), (F.col("action") == "allow").alias("allow"), F.col("path").alias("path"), F.concat("host", "path").alias("rule")).alias("r"))
    return above.join(named, "rule_host").groupBy("host").agg(F.collect_list("r").alias("rules"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict. edges(u, v) adds redirects known from elsewhere."""
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    links = link_edges(pages)
    links = links.union(edges.select("u", "v")) if edges is not None else links
    classes = components(links)
    split = pages.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def ruled(rows: DataFrame) -> DataFrame:
        table = written(host_rules(rows.select("host").distinct(), rules), "rules")
        fits = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
        return looked_up(rows, table, "host", "url").withColumn("best", fits).drop("rules")

    nodes = classes.select(F.col("node").alias("url"), "root", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    ranked = ruled(nodes).groupBy("root").agg(F.max("best.allow").alias("allowed"), F.count("best").alias("n"))
    spread = classes.join(ranked, "root").select(F.col("node").alias("url"), (F.col("allowed") | (F.col("n") == 0)).alias("class_allow"))
    own = ruled(split).join(spread, "url", "left")
    allow = F.coalesce(F.col("best.allow"), F.col("class_allow"), F.lit(True))
    return own.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"))
