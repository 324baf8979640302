"""URL filters: explicit rules first, then an empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are summed once per host, and from there
per registered domain and public suffix.  Each level is shrunk towards the one
above through a beta-binomial prior whose strength is fitted by moments over
the groups of that level.  A page is blocked when the lower bound of its host's
posterior (the beta quantile that the rate passes with ``confidence``) is above ``over``
times the overall rate, or above ``block_rate``: when the host is likely to be worse than
the corpus, which a few bad outcomes don't show and many do.  DataFrame functions only.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule, and is judged like a host without labels.  Labels with a null id
or outcome are ignored; several labels of one page all count.  Empty tables
give no rows; a host without labels, and so a table without them, blocks nothing.
Page rows are kept as they are, repeated rows included.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that under a country's two letters make a public suffix of two labels (fixed values; extend through the parameter).
SECOND_LEVEL = ("ac", "asn", "co", "com", "edu", "gen", "go", "gob", "gouv", "gov", "id", "info", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch", "web")
#: Further suffixes of two labels.
SUFFIXES = ()


@dataclass(frozen=True)
class Reputation:
    confidence: float = 0.8
    over: float = 1.0
    block_rate: float = 0.5
    least_strength: float = 1.0
    most_strength: float = 200.0
    second_level: tuple[str, ...] = SECOND_LEVEL
    suffixes: tuple[str, ...] = SUFFIXES


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES, second_level: tuple[str, ...] = SECOND_LEVEL) -> tuple[Column, Column]:
    """(registered domain, public suffix); a numeric or one-label host is its own domain.

    A suffix is the last label, or the last two where they are one of ``suffixes``
    or one of ``second_level`` under a country's two letters.
    """
    bare = F.regexp_replace(host, r"(^.*@)|(:\d*$)", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    own = (n < 2) | bare.rlike(r"^[\d.]+$") | bare.startswith("[")
    two = last(2).isin(*suffixes) if suffixes else F.lit(False)
    two |= F.get(labels, n - 2).isin(*second_level) & F.get(labels, n - 1).rlike("^[a-z]{2}$") if second_level else F.lit(False)
    suffix = F.when(own, bare).when(two, last(2)).otherwise(last(1))
    domain = F.when(own, bare).when(two, last(3)).otherwise(last(2))
    return domain, suffix


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest fitting (verdict, host, path) rule as a struct, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame, r: Reputation) -> DataFrame:
    """One row: overall rate m and the prior strength of a level by the method of moments."""
    s = groups.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"))
    n, k, g = (F.coalesce(F.col(x), F.lit(0)).cast("double") for x in "nkg")
    m = (k + 0.5) / (n + 1.0)
    # Between-group sum of squares against what binomial noise alone gives.
    between = F.coalesce(F.col("kk"), F.lit(0.0)) - F.when(n > 0, k * k / n).otherwise(0.0)
    noise = m * (1 - m)
    spread = F.when(n > 0, n - F.coalesce(F.col("nn"), F.lit(0)) / n).otherwise(0.0)
    rho = (between - (g - 1) * noise) / F.when((spread - (g - 1)) * noise > 0, (spread - (g - 1)) * noise)
    strength = F.when(rho > 0, F.least(F.lit(r.most_strength), F.greatest(F.lit(r.least_strength), 1 / rho - 1))).otherwise(r.most_strength)
    return s.select(m.alias("m"), strength.alias("c"))


def beta_low(a: Column, b: Column, confidence: float) -> Column:
    """The value that a beta(a, b) variable passes with this probability, by Paulson's approximation:
    the cube roots of its two gamma variables are near normal, and their ratio at the bound solves a quadratic."""
    z = NormalDist().inv_cdf(confidence)
    va, vb = 1 / (9 * a), 1 / (9 * b)
    ma, mb = 1 - va, 1 - vb
    under = ma * ma * vb + mb * mb * va - z * z * va * vb
    ratio = (ma * mb - z * F.sqrt(F.greatest(under, F.lit(0.0)))) / (mb * mb - z * z * vb)
    cube = a * ratio * ratio * ratio
    # With a or b near 0 cube roots are far from normal; there the bound is the variable's own normal one.
    mean = a / (a + b)
    plain = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1)))
    return F.when((ma > 0) & (mb > 0) & (mb * mb > z * z * vb) & (under >= 0) & (ratio > 0), cube / (b + cube)).otherwise(plain)


def host_reputation(outcomes: DataFrame, r: Reputation = Reputation()) -> DataFrame:
    """outcomes(host, bad 0/1) -> (host, n, k, mean, low, limit): hosts with labels, shrunk three levels deep."""
    domain, suffix = domain_of(F.col("host"), r.suffixes, r.second_level)
    hosts = outcomes.where(F.col("bad").isNotNull() & F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # The strengths are one row each, whatever the input.
    level = lambda df: F.broadcast(_strength(df, r))
    top = suffixes.join(level(suffixes)).select("suffix", ((F.col("k") + F.col("c") * F.col("m")) / (F.col("n") + F.col("c"))).alias("suffix_mean"))
    mid = domains.join(level(domains).select("c")).join(top, "suffix").select("domain", ((F.col("k") + F.col("c") * F.col("suffix_mean")) / (F.col("n") + F.col("c"))).alias("domain_mean"))
    low = hosts.join(level(hosts).select("c", "m")).join(mid, "domain")
    a = F.col("k") + F.col("c") * F.col("domain_mean")
    total = F.col("n") + F.col("c")
    mean = a / total
    return low.select("host", "n", "k", mean.alias("mean"), beta_low(a, total - a, r.confidence).alias("low"), F.least(F.lit(r.block_rate), r.over * F.col("m")).alias("limit"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str, str], ...], key: str = "page_id", url: str = "url", r: Reputation = Reputation()) -> DataFrame:
    """pages -> (key, host, path, rule, verdict, bad_mean, bad_low); outcomes(page, bad) are labels by page key."""
    judged = pages.select(F.col(key).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labelled = judged.join(outcomes.where(F.col("page").isNotNull()), "page").select("host", "bad")
    known = host_reputation(labelled, r).select("host", F.col("mean").alias("bad_mean"), F.col("low").alias("bad_low"), "limit")
    out = judged.join(known, "host", "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bad_low") > F.col("limit"), "block").otherwise("allow")
    return out.select(F.col("page").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "bad_mean", "bad_low")
