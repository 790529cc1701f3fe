"""URL filters: rules by host and path, and trust that spreads over the graph of links between hosts.

A url that a rule fits gets the rule's verdict. For the others the host decides. Hosts that the rules know are seeds:
trust spreads from trusted seeds along links (whom they link to is trusted), distrust from blocked seeds against links
(who links to them is distrusted), each by personalised PageRank. A host whose share of distrust exceeds its share of
trust is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loadgrid.operators.tables import written


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))
DAMPING = 0.85
ITERATIONS = 30
#: The lineage is cut after so many iterations.
CUT = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key_of(host: Column) -> Column:
    """host itself, or a digest of one that is longer than a name can be, so that no link carries more; # ends a host, so none begins with it."""
    return F.when(F.length(host) <= 255, host).otherwise(F.concat(F.lit("#"), F.sha2(host, 256)))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as (verdict, rule), else null. A rule fits its host and all subdomains."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.host + r.path).alias("rule"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links of pages to other hosts, summed before the shuffle. Links without a host stay on their own."""
    links = F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(_LINK), F.lit(1))
    # hosts are found once for a page, not for each of its links
    found = pages.select(key_of(host_of(F.col(url_col).cast("string"))).alias("src"), links.alias("links")).select("src", F.explode("links").alias("dst"))
    found = found.withColumn("dst", key_of(F.translate("dst", UPPER, LOWER))).where("src <> dst AND src <> '' AND dst <> ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(host, trust, distrust) of the hosts that any reaches, each column summing to 1.

    links (src, dst, n), seeds (host, kind, weight) with kind 0 for trust and 1 for distrust. Solves x = seeds + damping *
    links' * x by iteration, links' shared out by n; with hosts without links returning to the seeds, PageRank is this
    solution scaled to a sum of 1.
    """
    edges = links.select(F.lit(0).alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    sums = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = written(edges.join(sums, ["kind", "src"]).select("kind", "src", "dst", (damping * F.col("n") / F.col("total")).alias("share")))
    seeds = written(seeds.select("kind", "host", F.col("weight").cast("double").alias("x")))
    ranks = seeds
    if not edges.isEmpty():
        for turn in range(1, iterations + 1):
            passed = ranks.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("x") * F.col("share")).alias("x"))
            ranks = seeds.unionByName(passed).groupBy("kind", "host").agg(F.sum("x").alias("x"))
            if turn % CUT == 0:
                ranks = written(ranks)
    wide = ranks.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("x")).otherwise(0.0)).alias(name) for k, name in enumerate(("trust", "distrust"))))
    total = wide.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    return wide.select("host", (F.col("trust") / F.lit(total["t"] or 1.0)).alias("trust"), (F.col("distrust") / F.lit(total["d"] or 1.0)).alias("distrust"))


def rule_seeds(judged: DataFrame) -> DataFrame:
    """Seeds of judged pages (host, verdict): a host most of whose pages rules block is a blocked seed; else it is a
    trusted one if rules allow any of its pages. Its pages so decided are its weight."""
    n = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict") == "allow").alias("allowed")
    )
    bad = F.col("blocked") * 2 > F.col("pages")
    n = n.select("host", bad.cast("int").alias("kind"), F.when(bad, F.col("blocked")).otherwise(F.col("allowed")).alias("weight"))
    return n.where("weight > 0")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, trust, distrust.

    A url that is null or has no :// has an empty host and path, which no rule fits and no links reach: it is allowed,
    as are hosts that neither trust nor distrust reaches. A null html has no links. Rows are kept as they are, also
    repeated ones. Other columns have no effect. An empty table gives an empty result.
    """
    url = F.col(url_col).cast("string")
    named = pages.select(F.col(id_col).alias("__id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = named.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("__id", "host", "path", "found.rule", "found.verdict")
    hosts = written(spread(host_links(pages, url_col, html_col), rule_seeds(judged.select(key_of(F.col("host")).alias("host"), "verdict"))).withColumnRenamed("host", "key"))
    scored = judged.withColumn("key", key_of(F.col("host"))).join(hosts, "key", "left")
    own = F.when(F.coalesce(F.col("distrust"), F.lit(0.0)) > F.coalesce(F.col("trust"), F.lit(0.0)), "block").otherwise("allow")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return scored.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), zero("trust"), zero("distrust"))
