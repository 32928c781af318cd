"""URL filter: hand-written rules, then the empirical-Bayes reputation of the host, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import lower_ascii, written

#: Over-dispersion (1 / (strength + 1)) is kept inside this range, so a prior is never infinitely strong or empty.
LEAST_RHO, MOST_RHO = 0.001, 0.5


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.lit(2147483647)))
    return lower_ascii(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.lit(2147483647)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column, long_suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(suffix, registered domain): the last label, or one of `long_suffixes` such as co.uk, and one label more."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    parts = F.lit(1)
    for suffix in long_suffixes:
        parts = F.when((bare == suffix) | bare.endswith("." + suffix), F.lit(suffix.count(".") + 1)).otherwise(parts)
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return tail(parts), tail(parts + 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict), null without one. A rule 'host/path' fits the host and its subdomains; the longest wins.
    The list is meant to be short: it becomes one expression."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _shrunk(counts: DataFrame) -> tuple[DataFrame, Column]:
    """Adds the posterior `mean` to groups with n, s and a prior mean `mu`; and the strength of that prior, estimated
    from the spread between the groups (beta-binomial, method of moments), as a scalar subquery."""
    noise = F.col("n") * F.col("mu") * (1 - F.col("mu"))
    rho = F.sum(F.pow(F.col("s") - F.col("n") * F.col("mu"), 2) - noise) / F.nullif(F.sum(noise * (F.col("n") - 1)), F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(MOST_RHO)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    strength = counts.agg((1 / rho - 1).alias("strength")).scalar()
    return counts.withColumn("mean", (strength * F.col("mu") + F.col("s")) / (strength + F.col("n"))), strength


def reputation(outcomes: DataFrame, hosts: DataFrame, long_suffixes: Sequence[str] = (), z: float = 1.645) -> DataFrame:
    """Posterior of every host of `hosts` (column host), learned from `outcomes` (host, good: 0 or 1).

    Counts climb from host to registered domain to suffix. The prior of a suffix is centred on all outcomes, that of a
    domain on its suffix's posterior mean, that of a host on its domain's; each level's strength is estimated from the
    spread between its groups. A host without outcomes has its domain's mean as prior, then its suffix's, then the
    overall mean (0.5 without any outcome). Returns host, n, s, mean, bound: the posterior mean less `z` posterior
    deviations, within 0 and 1. Outcomes with a null host or null `good` don't count; each repeated outcome counts.

    A host with a third of all rows is one row after the map-side counts; the strengths are scalars.
    """
    suffix, domain = domain_of(F.col("host"), long_suffixes)
    known = outcomes.where(F.col("host").isNotNull() & F.col("good").isNotNull())
    per_host = known.groupBy("host").agg(F.count("good").alias("n"), F.sum(F.col("good").cast("long")).alias("s"))
    per_host = written(per_host.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "s"))
    total = lambda *keys: per_host.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    overall = per_host.agg(F.coalesce(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.5)).alias("mean")).scalar()
    prior_of = lambda level, key: level.select(key, F.col("mean").alias("mu"))
    suffixes, _ = _shrunk(total("suffix").withColumn("mu", overall))
    domains, _ = _shrunk(total("domain", "suffix").join(prior_of(suffixes, "suffix"), "suffix"))
    _, strength = _shrunk(per_host.join(prior_of(domains, "domain"), "domain"))

    wanted = hosts.select("host").distinct().select("host", domain.alias("domain"), suffix.alias("suffix"))
    wanted = (wanted.join(per_host.select("host", "n", "s"), "host", "left")
              .join(domains.select("domain", F.col("mean").alias("by_domain")), "domain", "left")
              .join(suffixes.select("suffix", F.col("mean").alias("by_suffix")), "suffix", "left"))
    prior = F.coalesce(F.col("by_domain"), F.col("by_suffix"), overall)
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0))
    wanted = wanted.select("host", n.alias("n"), s.alias("s"), (strength + n).alias("weight"),
                           ((strength * prior + s) / (strength + n)).alias("mean"))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return wanted.select("host", "n", "s", "mean", F.greatest(F.col("mean") - z * spread, F.lit(0.0)).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), key: str = "page_id",
          url: str = "url", long_suffixes: Sequence[str] = (), z: float = 1.645, threshold: float = 0.75) -> DataFrame:
    """Verdict for every row of `pages`: that of the longest fitting rule, else allow if the host's posterior bound is
    at least `threshold`. A null url, or one without '://', has an empty host and path and is judged as the host ''.
    Returns key, host, path, rule, verdict, bound; every row of `pages` once, repeated rows too. Other columns are left
    out, so their names can't clash."""
    seen = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = reputation(outcomes, seen, long_suffixes, z)
    rule, kind = rule_of(F.col("host"), F.col("path"), rules)
    by_bound = F.when(F.col("bound") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return seen.join(known.select("host", "bound"), "host").select(
        key, "host", "path", rule.alias("rule"), F.coalesce(kind, by_bound).alias("verdict"), "bound")
