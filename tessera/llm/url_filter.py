"""URL rules and empirical-Bayes host reputation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are written into the plan; more are joined by host suffix.
INLINE_RULES = 256
#: A host is blocked if its share of bad outcomes is over this bound with the confidence of Z standard deviations.
BAD_SHARE, Z = 0.5, 1.645
#: Outcomes that a parent's share counts as much as, from suffix to registered domain to host.
STRENGTH = 10.0


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.element_at(F.split(host, r"\."), -1)


def domain_of(host: Column) -> Column:
    """The last two labels of a host: what is registered below the suffix."""
    return F.substring_index(host, ".", -2)


def split_rule(rule: str) -> tuple[str, str]:
    at = rule.find("/")
    return (rule, "") if at < 0 else (rule[:at].lower(), rule[at:])


def _inline(rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits (host, path), as a struct (size, rule, verdict); of equal ones the last in order."""
    fits = []
    for rule, verdict in rules:
        host, path = split_rule(rule)
        fit = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _joined(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """As _inline, for many rules: an equi-join of each host's suffixes with the rules' hosts, before the longest is kept.

    Only distinct (host, path) are joined, so a host with many pages is joined once for each path.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(*split_rule(r), len(r), r, v) for r, v in rules], "r_host string, r_path string, size int, rule string, verdict string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    places = pages.select("host", "path").distinct()
    found = places.select("*", F.explode(ends).alias("r_host")).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = found.groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
    return pages.join(best, ["host", "path"], "left")


def host_reputation(outcomes: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """Posterior of a host's share of bad outcomes: (host, n, bad, mean, low).

    `outcomes` has (host, bad): bad 1 or 0, null where a page has no outcome. Shares are shrunk through beta priors from
    all outcomes to suffix, registered domain and host: a posterior mean, worth `strength` outcomes, is the prior of the
    next level. `low` is the mean less Z standard deviations of the host's beta posterior. Pages are aggregated by host
    before any shuffle, so a host with most of the pages costs as much as any other.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("d_n"), F.sum("bad").alias("d_bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_n").alias("s_n"), F.sum("d_bad").alias("s_bad"))
    prior = suffixes.agg((F.sum("s_bad") + 1.0) / (F.sum("s_n") + 2.0)).scalar()
    shrunk = lambda bad, n, to: (F.col(bad) + strength * to) / (F.col(n) + strength)
    s = suffixes.select("suffix", shrunk("s_bad", "s_n", prior).alias("s_mean"))
    d = domains.join(s, "suffix").select("domain", shrunk("d_bad", "d_n", F.col("s_mean")).alias("d_mean"))
    a, b = F.col("bad") + strength * F.col("d_mean"), F.col("n") - F.col("bad") + strength * (1 - F.col("d_mean"))
    mean, weight = a / (a + b), a + b
    return hosts.join(d, "domain").select("host", "n", "bad", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("low"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame, bad_share: float = BAD_SHARE, strength: float = STRENGTH) -> DataFrame:
    """Judge each page (page_id, url): (page_id, host, path, rule, verdict, mean).

    The longest rule that fits decides; without one, the host's reputation: block if the lower bound of its share of
    bad outcomes is over `bad_share`. `outcomes` has (page_id, bad). Hosts without outcomes have their domain's,
    suffix's or the general share. Null urls and urls without `://` have an empty host and path, and a reputation as
    any host. Rows that repeat a page_id are judged each on its own.
    """
    places = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) <= INLINE_RULES:
        ruled = places.withColumn("best", _inline(rules))
    else:
        ruled = _joined(places, rules)
    labelled = places.join(outcomes.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    reputation = host_reputation(labelled.select("host", "bad"), strength).select("host", F.round("mean", 6).alias("bad_share"), (F.col("low") > bad_share).alias("bad_host"))
    method = F.when(F.col("bad_host"), "block").otherwise("allow")
    return ruled.join(reputation, "host", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), "bad_share"
    )
