"""Operator 8, URL filter: per-host path-template tree with smoothed labelled purity (DataFrame functions only).

Fixed rules (host, path) come first: a rule fits its host and all subdomains if the url's path
starts with the rule's; the longest rule wins. Pages without a rule get the verdict of their
template; the pages with a rule are the labels.

The tree of a host is built from the root, level by level, until no path has segments left. In a
segment, runs of digits and long hexadecimal tokens are variable and become wildcards. Under one parent,

* each labelled branch is compared with its siblings: a two-proportion z-test of the share of
  blocked labels. Those without a significant difference merge into one wildcard branch ``*``; the others stay,
  however many there are;
* branches without labels, of which nothing is known, are never merged with labelled ones. They are
  variable, and become one wildcard branch of their own (``*``, beside labelled siblings ``*#``, as no path
  has a ``#``), if at least half of their pages are the only ones of their branch (that share estimates
  the chance that the next page brings a new segment); else they stay.

A node is a grouped count of (host, prefix, segment). Segments that all pages below a branch
share are taken in one step, so there are as many steps as forks on a path, at any depth. Purity is the blocked share of a template's labels, smoothed
with ``strength`` pseudo-labels. They have the share of its host, itself smoothed in this way
towards the domain (last two labels) and all pages, but at most ``most_prior``: labels of other
templates alone never reject one. A template of purity ``threshold`` or more is rejected.

A host with a third of all pages is counted by partial aggregates and split in the joins by adaptive
execution, as both sides are written tables.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and the
verdict of the empty host; repeated rows get each their row; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, table

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null without one."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    out = none
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The path's segments with digits and long hexadecimal tokens as wildcards; a ``*`` of the url is escaped."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, "(?i)[0-9a-f]{16,}", "{x}"), "[0-9]+", "{n}"))
    return F.transform(parts, lambda x: F.when(x == "*", "%2A").otherwise(x))


def grow(rows: DataFrame, z_limit: float) -> DataFrame:
    """Rows (host, segs, prefix, label) a branch deeper: prefix extended by the branch, or a wildcard, and what all below it share."""
    rows = rows.withColumn("seg", F.get("segs", F.lit(0))).withColumn("segs", F.slice("segs", 2, 1 << 30))
    nodes = materialize(rows.groupBy("host", "prefix", "seg").agg(
        F.count(F.lit(1)).alias("pages"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"),
        F.min("segs").alias("low"), F.max("segs").alias("high")))
    unknown = F.col("labelled") == 0
    parents = nodes.groupBy("host", "prefix").agg(
        F.count_if(~unknown).alias("known"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"),
        F.count_if(unknown).alias("unknown"), F.sum(F.when(unknown, F.col("pages"))).alias("unknown_pages"),
        F.count_if(unknown & (F.col("pages") == 1)).alias("single"))
    judged = nodes.join(parents, ["host", "prefix"])
    other = F.col("all_labelled") - F.col("labelled")
    share = F.try_divide("all_blocked", "all_labelled")
    spread = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), other)))
    gap = F.try_divide("blocked", "labelled") - F.try_divide(F.col("all_blocked") - F.col("blocked"), other)
    differs = F.coalesce(F.abs(F.try_divide(gap, spread)) >= z_limit, F.lit(False))  # no evidence, no difference
    alike = (F.col("known") > 1) & ~unknown & ~differs
    variable = unknown & (F.col("unknown") > 1) & (2 * F.col("single") >= F.col("unknown_pages"))
    wild = F.when(alike, "*").when(variable, F.when(F.col("known") > 1, "*#").otherwise("*"))
    same = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))  # what least and greatest share, all share
    at = F.array_position(same, F.lit(False)).cast("int")
    shared = F.when(wild.isNotNull(), 0).when(at > 0, at - 1).otherwise(F.size("low"))
    judged = materialize(judged.select("host", "prefix", "seg", F.coalesce(wild, "seg").alias("branch"), shared.alias("shared")))
    drop_table(nodes)
    deeper = rows.join(judged, ["host", "prefix", "seg"])
    step = F.array_join(F.concat(F.array("branch"), F.slice("segs", F.lit(1), F.col("shared"))), "/")
    out = materialize(deeper.select("row", "host", "label", F.slice("segs", F.col("shared") + 1, F.lit(1 << 30)).alias("segs"),
                                    F.concat("prefix", F.lit("/"), step).alias("prefix")))
    drop_table(judged)
    return out


def purities(rows: DataFrame, strength: float, most_prior: float) -> DataFrame:
    """(host, prefix, purity) of every template, as a written table."""
    counted = materialize(rows.groupBy("host", "prefix").agg(
        F.count("label").alias("n0"), F.coalesce(F.sum("label"), F.lit(0)).alias("b0")).withColumn(
        "domain", F.substring_index("host", ".", -2)))
    hosts = counted.groupBy("domain", "host").agg(F.sum("n0").alias("n1"), F.sum("b0").alias("b1"))
    domains = hosts.groupBy("domain").agg(F.sum("n1").alias("n2"), F.sum("b1").alias("b2"))
    whole = domains.agg(F.sum("n2").alias("n3"), F.sum("b2").alias("b3")).first()  # one row
    prior: Column = F.lit(((whole.b3 or 0) + 1.0) / ((whole.n3 or 0) + 2.0))
    for level in (2, 1, 0):
        prior = F.least(prior, F.lit(most_prior)) if not level else prior
        prior = (F.col(f"b{level}") + strength * prior) / (F.col(f"n{level}") + strength)
    out = materialize(counted.join(hosts, ["domain", "host"]).join(domains, "domain").select("host", "prefix", prior.alias("purity")))
    drop_table(counted)
    return out


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: Sequence[tuple[str, str, str]] = RULES,
               z_limit: float = 1.96, strength: float = 4.0,
               most_prior: float = 0.4, threshold: float = 0.5) -> DataFrame:
    """(``id_col``, host, path, rule, verdict, template, purity) of every page."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("row", F.monotonically_increasing_id())
    parsed = materialize(parsed)
    rows = parsed.select("row", "host", (F.col("found.verdict") == "block").cast("long").alias("label"),
                         segments(F.col("path")).alias("segs"), F.lit("").alias("prefix"))
    steps, ended = [], rows.where(F.size("segs") == 0).drop("segs")
    rows = rows.where(F.size("segs") > 0)
    while rows.limit(1).count():
        steps.append(grow(rows, z_limit))
        ended = ended.union(steps[-1].where(F.size("segs") == 0).drop("segs"))
        rows = steps[-1].where(F.size("segs") > 0)
    rows = ended
    purity = purities(rows, strength, most_prior)
    told = materialize(rows.select("row", "host", "prefix").join(purity, ["host", "prefix"]).select("row", "prefix", "purity"))
    for old in (*steps, purity):
        drop_table(old)
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return parsed.join(told, "row").select(
        F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"),
        F.col("prefix").alias("template"), "purity")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
