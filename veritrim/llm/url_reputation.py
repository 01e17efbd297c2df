"""URL filters by empirical-Bayes host reputation.

Hosts are judged by the labelled outcomes of their pages. Every level (suffix, registered domain, host) has a
beta-binomial prior: its mean is the shrunk rate of the level above, its weight the over-dispersion that the outcomes
show between the members of that level. A host is blocked when the lower bound of its posterior bad rate is above a
limit, so that few pages never condemn a host.

Only counts per host are shuffled (after map-side sums), so a host with a third of all pages is one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrim.llm.common import lower_ascii


@dataclass(frozen=True)
class Limits:
    """``bound``: standard deviations below the posterior mean; ``block_above``: the bad rate that condemns."""

    bound: float = 1.645
    block_above: float = 0.5
    #: Suffixes of several labels, such as ``co.uk``; any other suffix is the last label. Kept in the plan.
    suffixes: tuple[str, ...] = ()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]], part: str) -> Column:
    """``rule`` or ``verdict`` of the longest fitting rule; NULL if none fits.

    A rule such as ``("example.com/de/", "block")`` fits its host and all subdomains, if the path starts with
    the rule's path. Rules are a small parameter that stays in the plan (some hundreds at most).
    """
    chosen = F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is tested first, so it comes last here
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        chosen = F.when(fits, F.lit(rule if part == "rule" else verdict)).otherwise(chosen)
    return chosen


def suffix_of(host: Column, limits: Limits) -> Column:
    found = F.substring_index(host, ".", -1)
    for suffix in sorted(limits.suffixes, key=len):
        found = F.when((host == suffix) | host.endswith(f".{suffix}"), F.lit(suffix)).otherwise(found)
    return found


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label before it."""
    before = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(host == suffix, host).otherwise(F.concat_ws(".", F.substring_index(before, ".", -1), suffix))


def _spread(members: DataFrame, mean: float) -> float:
    """Weight of the prior over these members (columns n, bad), by the method of moments; one row reaches the driver.

    It weighs at least two pages, so that hosts at odds with each other do not make every page a verdict.
    """
    n, k, square, between = members.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double"),
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)),
        F.coalesce(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2)), F.lit(0.0)),
    ).first()
    free = n - square / n - (k - 1) if n else 0.0
    rho = (between / (mean * (1 - mean)) - (k - 1)) / free if free > 0 else 0.5
    return 1 / min(max(rho, 0.001), 1 / 3) - 1


def host_reputation(outcomes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per host of ``outcomes`` (host, bad: 1, 0 or NULL for pages without a label).

    Columns: host, domain, suffix, n (labelled pages), bad (sum), mean and bound (lower) of the posterior bad rate,
    blocked. Hosts without any label get the rate of their domain, else suffix, else all. An empty table gives an empty
    one; a NULL host counts as the empty host. Repeated rows are separate outcomes.
    """
    hosts = (
        outcomes.groupBy(F.coalesce(F.col("host"), F.lit("")).alias("host"))
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("suffix", suffix_of(F.col("host"), limits))
        .withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    )
    sums = lambda df, *key: df.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = sums(hosts, "suffix", "domain")
    suffixes = sums(domains, "suffix")
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    mean = (bad + 1) / (n + 2)
    weight = {name: _spread(df.filter("n > 0"), mean) for name, df in (("s", suffixes), ("d", domains), ("h", hosts))}
    shrunk = lambda prior, w: (F.col("bad") + w * prior) / (F.col("n") + w)
    suffix_rate = suffixes.select("suffix", shrunk(F.lit(mean), weight["s"]).alias("suffix_rate"))
    domain_rate = domains.join(suffix_rate, "suffix").select(
        "suffix", "domain", shrunk(F.col("suffix_rate"), weight["d"]).alias("domain_rate")
    )
    strength = F.col("n") + weight["h"]
    return (
        hosts.join(domain_rate, ["suffix", "domain"])
        .withColumn("mean", shrunk(F.col("domain_rate"), weight["h"]))
        .withColumn("bound", F.col("mean") - limits.bound * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (strength + 1)))
        .withColumn("blocked", F.col("bound") > limits.block_above)
        .select("host", "domain", "suffix", "n", "bad", "mean", "bound", "blocked")
    )


def judge(pages: DataFrame, outcome: Column, rules: list[tuple[str, str]], limits: Limits = Limits()) -> DataFrame:
    """Adds host, path, rule and verdict to ``pages`` (a column url; equally named columns are replaced).

    ``outcome`` is the label of a page (1 bad, 0 good, NULL none), an expression over the page's columns and
    host, path, ruled (the verdict of the rule that fits, else NULL).
    """
    own = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    own = own.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules, "rule"))
    own = own.withColumn("ruled", matching_rule(F.col("host"), F.col("path"), rules, "verdict"))
    known = host_reputation(own.select("host", outcome.alias("bad")), limits)
    blocked = known.filter("blocked").select(F.col("host").alias("_host"))
    return (
        own.join(blocked, own["host"] == blocked["_host"], "left")
        .withColumn("verdict", F.coalesce("ruled", F.when(F.col("_host").isNotNull(), "block").otherwise("allow")))
        .drop("_host", "ruled")
    )
