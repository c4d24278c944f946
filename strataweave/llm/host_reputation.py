"""URL filter by empirical-Bayes host reputation and listed rules.

Labelled page outcomes (good or bad) are counted by host. A suffix's rate of bad pages is shrunk towards
the rate of all pages, a registered domain's towards its suffix, a host's towards its domain, each
through a beta-binomial prior whose strength is fitted by moments from the spread of the level's rates.
A host is blocked when the lower bound of its posterior rate exceeds a limit: few pages never suffice.
Hosts without labelled pages take the posterior of the nearest level that is known.

Everything is DataFrame functions; counts are aggregated before any shuffle, so a host with a third of
all pages is one row per task.

Suffix: the last label. Registered domain: the last two labels, as no public suffix list is at hand. Null urls, and urls without ``://``, have empty host and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z = 1.645  # one-sided 95 %
LIMIT = 0.5  # hosts with a higher rate of bad pages are blocked
STRENGTH = (1.0, 1000.0)  # a prior weighs as much as this many pages


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def parents(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host, then path) that fits, both null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones win
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame, prior: Column) -> Column:
    """Fits a + b of the beta priors around ``prior`` from the spread of the rates bad / n, one row."""
    noise = F.sum(prior * (1 - prior))  # binomial variance of n * rate, by n
    excess = F.sum(F.pow(F.col("bad") - F.col("n") * prior, 2) / F.col("n")) - noise
    spread = F.sum((F.col("n") - 1) * prior * (1 - prior))
    rho = F.greatest(excess / F.greatest(spread, F.lit(1e-12)), F.lit(1e-12))
    return F.least(F.greatest(1 / rho - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def reputations(counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Posterior (a, b) by host, by domain and by suffix, and overall, from ``counts(host, n, bad)``."""
    domain, suffix = parents(F.col("host"))
    hosts = scratch.save(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    domains = scratch.save(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = scratch.save(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = ((total.bad or 0) + 1.0) / ((total.n or 0) + 2.0)

    def posterior(level: DataFrame) -> DataFrame:
        """``level(n, bad, prior)`` with a and b."""
        strength = level.agg(_strength(level, F.col("prior")).alias("s")).first().s
        strength = float(STRENGTH[1] if strength is None else strength)
        return level.withColumn("a", F.lit(strength) * F.col("prior") + F.col("bad")).withColumn(
            "b", F.lit(strength) * (1 - F.col("prior")) + F.col("n") - F.col("bad")
        )

    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("prior")
    suffixes = scratch.save(posterior(suffixes.withColumn("prior", F.lit(rate))))
    domains = scratch.save(posterior(domains.join(suffixes.select("suffix", mean), "suffix")))
    hosts = scratch.save(posterior(hosts.join(domains.select("domain", mean), "domain")))
    overall = (rate * STRENGTH[0], (1 - rate) * STRENGTH[0])
    return hosts, domains, suffixes, overall


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """Normal approximation of the lower posterior quantile of a beta distribution."""
    mean = a / (a + b)
    return mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    limit: float = LIMIT,
) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, bad_rate, bad_bound.

    ``outcomes(url, bad)`` are labelled urls with bad 0 or 1 (null: not labelled).
    """
    scratch = Scratch(pages.sparkSession, "llm-hosts")
    host, path = split_url(F.col("url"))
    counts = outcomes.where("bad IS NOT NULL").groupBy(host.alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")
    )
    hosts, domains, suffixes, overall = reputations(counts, scratch)

    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = parents(F.col("host"))
    names = scratch.save(seen.select("host").distinct())  # one row per host, hot ones included
    judged = (
        names.withColumn("domain", domain).withColumn("suffix", suffix)
        .join(hosts.select("host", F.struct("a", "b").alias("h")), "host", "left")
        .join(domains.select("domain", F.struct("a", "b").alias("d")), "domain", "left")
        .join(suffixes.select("suffix", F.struct("a", "b").alias("s")), "suffix", "left")
        .select(
            "host",
            F.coalesce("h", "d", "s", F.struct(F.lit(overall[0]).alias("a"), F.lit(overall[1]).alias("b"))).alias("p"),
        )
        .select(
            "host",
            (F.col("p.a") / (F.col("p.a") + F.col("p.b"))).alias("bad_rate"),
            lower_bound(F.col("p.a"), F.col("p.b")).alias("bad_bound"),
        )
    )
    judged = scratch.save(judged)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return seen.join(judged, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "bad_bound"
    )
