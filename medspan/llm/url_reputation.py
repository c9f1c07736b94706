"""URL filter by rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are summed by host, registered domain and
suffix. Each level's beta-binomial prior is centred on its parent's posterior
mean; its strength is fitted by the method of moments from the spread of the
level's rates. A host is blocked if the lower bound of its posterior bad rate
is over the threshold; a host without outcomes takes its domain's posterior,
and one without that its suffix's.

Defined results: a null url, or one without ``://``, has empty host and path
and is judged by the overall rate; repeated rows are judged alike and each is
returned; an empty table gives no rows; other columns are not looked at.
Outcomes with a null url or label don't count.

Outcomes are an input: rows of (url, bad), or a column over the pages themselves.
``thin_page`` is such a column: a page with more links than one for each hundred
visible characters is a bad outcome; a page without html has none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medspan.llm._spark import checkpoint

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

@dataclass(frozen=True)
class Reputation:
    """threshold: a posterior lower bound over it blocks. z: the bound's distance in
    standard deviations. least, most: limits of a fitted prior strength."""

    threshold: float = 0.5
    z: float = 1.0
    least: float = 2.0
    most: float = 200.0


def with_place(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path of an url."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return pages.withColumns(
        {
            "host": F.translate(authority, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            "path": F.regexp_extract(F.substring(rest, F.length(authority) + 1, F.length(rest)), r"^([^?#]*)", 1),
        }
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. Rules are a parameter
    of the query, compiled into one expression; for many thousands use a table."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.when(fits, F.lit(at + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _levels(host: Column) -> dict[str, Column]:
    bare = F.regexp_replace(host, r":\d*$", "")
    return {"domain": F.substring_index(bare, ".", -2), "suffix": F.substring_index(bare, ".", -1)}


def _strength(counts: DataFrame, parent: str, reputation: Reputation) -> float:
    """Beta-binomial strength by moments from rows (n, bad, parent rate): one aggregated row."""
    p = F.col(parent)
    got = counts.agg(
        F.sum(F.col("n")).alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * p * (1 - p)).alias("within"),
        F.sum(F.pow(F.col("bad") - F.col("n") * p, F.lit(2.0))).alias("spread"),
    ).first()
    if not got or not got["n"] or not got["within"]:
        return reputation.most
    # E[(bad - n p)^2] = n p (1-p) (1 + (n-1) rho); strength = 1 / rho - 1
    mean_variance = got["within"] / got["n"]
    excess = got["spread"] - got["within"]
    scale = mean_variance * (got["nn"] - got["n"])
    if excess <= 0 or scale <= 0:
        return reputation.most
    return float(min(reputation.most, max(reputation.least, scale / excess - 1)))


def host_reputation(sums: DataFrame, reputation: Reputation = Reputation()) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posterior tables by host, domain and suffix, and the overall rate.

    sums: host, n (outcomes) and bad (bad ones). Every level is summed from the one below."""
    hosts = sums.where((F.col("n") > 0) & (F.col("host") != "")).select("host", "n", "bad").withColumns(_levels(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0.0) + 0.5) / ((total["n"] or 0.0) + 1.0)
    suffixes = suffixes.withColumn("p0", F.lit(overall))
    suffixes = _posterior(suffixes, "p0", _strength(suffixes, "p0", reputation)).select("suffix", F.col("mean").alias("suffix_mean"), F.col("var").alias("suffix_var"))
    domains = domains.join(suffixes, "suffix")
    domains = _posterior(domains, "suffix_mean", _strength(domains, "suffix_mean", reputation)).select("domain", F.col("mean").alias("domain_mean"), F.col("var").alias("domain_var"))
    hosts = hosts.join(domains, "domain")
    hosts = _posterior(hosts, "domain_mean", _strength(hosts, "domain_mean", reputation)).select("host", F.col("mean").alias("host_mean"), F.col("var").alias("host_var"))
    return hosts, domains, suffixes, overall


def _posterior(counts: DataFrame, parent: str, strength: float) -> DataFrame:
    a = F.col(parent) * strength + F.col("bad")
    b = (1 - F.col(parent)) * strength + F.col("n") - F.col("bad")
    return counts.withColumns({"mean": a / (a + b), "var": a * b / ((a + b) * (a + b) * (a + b + 1))})


def thin_page(html: str = "html", least: int = 100) -> Column:
    """1 for a page with more links than one for each ``least`` visible characters, 0 for others, null without html."""
    visible = F.length(F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", ""), r"[ \t\r\n]+", ""))
    return (F.regexp_count(F.col(html), F.lit(r"(?i)<a[ >]")) * least > visible).cast("double")


def host_sums(pages: DataFrame, outcomes: DataFrame | Column, url: str = "url") -> DataFrame:
    """host, pages, n (outcomes) and bad of every host of pages, and of the outcomes' other hosts, as a table: the only step that reads outcomes."""
    if isinstance(outcomes, Column):
        rows = pages.select(F.col(url).alias("url"), F.lit(1).alias("pages"), outcomes.cast("double").alias("bad"))
    else:
        rows = pages.select(F.col(url).alias("url"), F.lit(1).alias("pages"), F.lit(None).cast("double").alias("bad")).unionByName(outcomes.select("url", F.lit(0).alias("pages"), F.col("bad").cast("double").alias("bad")))
    placed = with_place(rows).groupBy("host").agg(F.sum("pages").alias("pages"), F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    return checkpoint(placed)


def judge_urls(pages: DataFrame, outcomes: DataFrame | Column, rules=RULES, reputation: Reputation = Reputation(), page_id: str = "page_id", url: str = "url", hot: int = 1000) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_rate, bad_bound.

    outcomes: rows of url and bad, or a column bad over the pages; pages are read once for
    the sums by host and once to be judged. Hosts with over 1 / hot of all pages, at most
    so many, are broadcast; the pages of all others meet their host's row by a join."""
    sums = host_sums(pages, outcomes, url)
    hosts, domains, suffixes, overall = host_reputation(sums, reputation)
    mean, var = F.coalesce("host_mean", "domain_mean", "suffix_mean", F.lit(overall)), F.coalesce("host_var", "domain_var", "suffix_var", F.lit(0.0))
    known = (
        sums.where("pages > 0").select("host", "pages").withColumns(_levels(F.col("host")))
        .join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
        .select("host", "pages", mean.alias("bad_rate"), F.greatest(F.lit(0.0), mean - reputation.z * F.sqrt(var)).alias("bad_bound"))
    )
    many = (sums.agg(F.sum("pages")).first()[0] or 0) / hot
    common = known.where(F.col("pages") > many).select("host", F.col("bad_rate").alias("hot_rate"), F.col("bad_bound").alias("hot_bound"))
    others = known.where(F.col("pages") <= many).select(F.col("host").alias("key"), F.col("bad_rate").alias("own_rate"), F.col("bad_bound").alias("own_bound"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    placed = with_place(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))).select("page_id", "host", "path")
    # no host holds a "#": pages of common hosts are spread over keys that meet nothing
    key = F.when(F.col("hot_rate").isNotNull(), F.concat(F.lit("#"), F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 16)).cast("string"))).otherwise(F.col("host"))
    judged = placed.join(F.broadcast(common), "host", "left").withColumn("key", key).join(others, "key", "left")
    judged = judged.withColumns({"bad_rate": F.coalesce("hot_rate", "own_rate"), "bad_bound": F.coalesce("hot_bound", "own_bound")})
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad_bound") > reputation.threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "bad_rate", "bad_bound",
    )
