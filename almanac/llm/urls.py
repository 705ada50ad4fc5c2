"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host. How bad a host's pages are is estimated by beta-binomial
shrinkage down a tree: all hosts, public suffix, registered domain, host. At each level the parent's estimate is the
prior mean, worth a number of pages that is fitted from how much its children differ (method of moments, between 1 and
1,000), so a host of few labelled pages stands where its domain stands, and a host without any likewise. A page is
blocked if, by the normal approximation to its host's posterior, the lower bound of the bad share, ``z`` standard
deviations below the mean, exceeds ``lift`` times the share over all pages: how common bad pages are sets the limit,
and a host must be credibly worse than that.
Rules that the caller states go first; among the rules that fit a page the longest wins.

Counting is by host (partial sums first), estimates are joined to pages by host, domain and suffix; all of it is
DataFrame operations, so a host that a third of all pages share is split by adaptive execution like any skewed join.

Defined results: a null url, or one without ``://``, has an empty host and path; the empty host has a reputation like
any other host. Outcomes that are null don't count. Repeated pages are judged each by itself; a null page_id has no
outcome, and its page is judged by its host like any other. All shares start from one page of share PRIOR, so without
any outcome nothing is blocked but by a rule. Host names that are IPv4 addresses or hold a port
are taken as they are: what follows the last dot is the suffix. Other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.session import cut_lineage

#: Second-level labels that are public suffixes below a country's label. Fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "gv", "id", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: The share of bad pages that one page is taken to have said before any is seen.
PRIOR = 0.25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The longest of ``suffixes`` that the host ends with; else the last two labels where they are like ``co.uk``, or the last."""
    two = F.regexp_extract(host, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[^.]{{2}})$", 1)
    found = F.when(two != "", two).otherwise(F.substring_index(host, ".", -1))
    for suffix in sorted(suffixes, key=len):
        found = F.when((host == suffix) | host.endswith(f".{suffix}"), F.lit(suffix)).otherwise(found)
    return found


def domain_of(host: Column, suffix: Column) -> Column:
    """The label before the suffix, and the suffix."""
    before = F.expr("left(host, greatest(0, char_length(host) - char_length(suffix) - 1))")
    label = F.substring_index(before, ".", -1)
    return F.when(label == "", suffix).otherwise(F.concat(label, F.lit("."), suffix))


def with_parts(pages: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    return parts.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))


def matching_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule, as ``verdict rule``, that fits columns host and path; null if none does.

    A rule is a host and the beginning of a path, ``example.com/en/7``; it fits the host and all its subdomains.
    """
    found = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        found = F.when(fits, F.lit(f"{verdict} {rule}")).otherwise(found)
    return found


_LEVELS = ("suffix", "domain", "host")


def reputations(outcomes: DataFrame) -> dict[str, DataFrame]:
    """By level: its key, n, bad, mean and worth (pages that the estimate stands for); and the root's single row.

    ``outcomes`` has host, domain, suffix and bad (0 or 1) for each labelled page.
    """
    by_host = outcomes.where("bad is not null").groupBy("suffix", "domain", "host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counts = {"host": cut_lineage(by_host)}  # all levels are made of these, a row a host
    for level, below in (("domain", "host"), ("suffix", "domain")):
        keys = _LEVELS[: _LEVELS.index(level) + 1]
        counts[level] = counts[below].groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    root = counts["suffix"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    found = {"root": root.select(((F.col("bad") + F.lit(PRIOR)) / (F.col("n") + F.lit(1.0))).alias("mean"))}
    above = found["root"]
    for level in _LEVELS:
        parent = _LEVELS[: _LEVELS.index(level)]
        own = counts[level].withColumn("share", F.col("bad") / F.col("n"))
        if parent:
            joined = own.join(above.select(*parent, F.col("mean").alias("prior")), list(parent))
        else:
            joined = own.crossJoin(F.broadcast(above.select(F.col("mean").alias("prior"))))  # one row
        spread = joined.groupBy(*parent, "prior").agg(
            F.sum(F.col("n") * F.pow(F.col("share") - F.col("prior"), 2)).alias("between"), F.count("*").alias("children"), F.sum("n").alias("pages"), F.sum(F.col("n") * F.col("n")).alias("squares")
        )
        variance = F.col("prior") * (1 - F.col("prior"))
        # E[between] = variance * (children * (1 - rho) + pages * rho); worth = 1 / rho - 1
        rho = (F.col("between") / variance - F.col("children")) / F.greatest(F.col("pages") - F.col("children"), F.lit(1))
        worth = spread.select(*parent, F.least(F.greatest(1 / F.greatest(rho, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1000.0)).alias("prior_worth"))
        joined = joined.join(worth, list(parent)) if parent else joined.crossJoin(F.broadcast(worth))
        mean = (F.col("bad") + F.col("prior") * F.col("prior_worth")) / (F.col("n") + F.col("prior_worth"))
        found[level] = joined.select(*parent, level, "n", "bad", mean.alias("mean"), (F.col("n") + F.col("prior_worth")).alias("worth"))
        above = found[level]
    return found


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), lift: float = 1.0, z: float = 1.0, suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule, bad_share, lower_bound, limit and verdict of every page.

    ``outcomes`` (page_id, bad) are the labelled pages; a page that has several counts with its worst. ``suffixes`` are
    public suffixes, like those of hosting services, beside the top-level ones.
    """
    parts = with_parts(pages, suffixes)
    marked = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    levels = reputations(parts.join(marked, "page_id").select(*_LEVELS, "bad"))
    hosts = parts.select(*_LEVELS).distinct()
    known = hosts.crossJoin(F.broadcast(levels["root"].select(F.col("mean").alias("root_mean"))))
    for level in _LEVELS:
        keys = list(_LEVELS[: _LEVELS.index(level) + 1])
        known = known.join(levels[level].select(*keys, F.col("mean").alias(f"{level}_mean"), F.col("worth").alias(f"{level}_worth")), keys, "left")
    mean = F.coalesce("host_mean", "domain_mean", "suffix_mean", "root_mean")
    worth = F.coalesce("host_worth", "domain_worth", "suffix_worth", F.lit(1.0))
    bound = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (worth + 1)))
    scored = known.select("host", mean.alias("bad_share"), bound.alias("lower_bound"), (F.lit(lift) * F.col("root_mean")).alias("limit"))
    rule = matching_rule(rules)
    judged = parts.select("page_id", "host", "path", rule.alias("matched")).join(scored, "host")
    verdict = F.coalesce(F.substring_index("matched", " ", 1), F.when(F.col("lower_bound") > F.col("limit"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.expr("substr(matched, instr(matched, ' ') + 1)").alias("rule"), "bad_share", "lower_bound", "limit", verdict.alias("verdict"))
