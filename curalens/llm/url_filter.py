"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host (columns only, no Python)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Rules are compiled into one CASE expression, so their number is bounded.
MAX_RULES = 2000

#: Second-level labels under which country domains register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; null or no :// gives the empty text."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two below a country code with a second level, such as co.uk."""
    last, second = F.substring_index(host, ".", -1), F.regexp_extract(host, r"([^.]+)\.[^.]+$", 1)
    return F.when((F.length(last) == 2) & second.isin(*SECOND_LEVEL), F.concat(second, F.lit("."), last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    second = "|".join(SECOND_LEVEL)
    return F.regexp_extract(host, rf"((?:[^.]+\.)?(?:(?:{second})\.[^.]{{2}}|[^.]+))$", 1)


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    A rule is host/path-prefix. It fits its host and every subdomain if the path starts with the rule's path.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled into the plan")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: len(r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """outcomes(host, bad 0/1) -> one row per host: (host, mean, bound) of its bad rate.

    Beta-binomial shrinkage goes down the levels: the suffix is shrunk to the overall rate, the registered domain to
    its suffix, the host to its domain. Each level's prior strength comes from the method of moments on that level's
    groups, and `bound` is the posterior mean less z posterior deviations.
    Only counts per host are shuffled: hosts with many pages are summed before the exchange.
    """
    counts = outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("k"))
    counts = counts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    overall = counts.agg(F.coalesce((F.sum("k") + 1) / (F.sum("n") + 2), F.lit(0.5)).alias("p_all"))

    def strength(level: DataFrame) -> DataFrame:
        """Method of moments for a + b: mean rate m, between-group variance v gives m(1-m)/v - 1, kept in [1, 1000]."""
        rate = F.col("k") / F.col("n")
        m, total = F.sum("k") / F.sum("n"), F.sum("n")
        got = level.agg(m.alias("m"), total.alias("t"), F.count("*").alias("g"), F.sum(F.col("n") * rate * rate).alias("q"))
        within = F.col("m") * (1 - F.col("m"))
        v = F.col("q") / F.col("t") - F.col("m") * F.col("m") - within * F.col("g") / F.col("t")
        s = F.when(v > 1e-9, within / v - 1).otherwise(F.lit(1000.0))
        return got.select(F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), s)), F.lit(1000.0)).alias("s"))

    by_domain = counts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.min("suffix").alias("suffix"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # the cross joins below are with one-row tables of level constants
    suffix = by_suffix.join(F.broadcast(overall)).join(F.broadcast(strength(by_suffix))).select(
        "suffix", ((F.col("k") + F.col("s") * F.col("p_all")) / (F.col("n") + F.col("s"))).alias("p_suffix")
    )
    domain = by_domain.join(suffix, "suffix").join(F.broadcast(strength(by_domain))).select(
        "domain", ((F.col("k") + F.col("s") * F.col("p_suffix")) / (F.col("n") + F.col("s"))).alias("p_domain")
    )
    host = counts.join(domain, "domain").join(F.broadcast(strength(counts)))
    mean, weight = (F.col("k") + F.col("s") * F.col("p_domain")) / (F.col("n") + F.col("s")), F.col("n") + F.col("s")
    return host.select("host", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("bound"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], limit: float = 0.5, z: float = 1.645,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: (id, host, path, rule, verdict, bad_bound).

    outcomes(url, bad): labelled pages; rows with a null label are ignored. Where no rule fits, a host is blocked when
    the lower bound of its bad rate exceeds `limit`; hosts without outcomes, null and malformed urls are allowed.
    Repeated rows stay repeated, an empty table gives an empty result, and other columns are ignored.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = outcomes.where(F.col("bad").isNotNull()).select(host_of(F.col("url")).alias("host"), "bad")
    known = reputation(seen, z).select("host", F.col("bound").alias("bad_bound"))
    rule, said = rule_column(F.col("host"), F.col("path"), rules)
    return base.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(said, F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "bad_bound",
    )
