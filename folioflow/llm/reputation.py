"""URL filters: rules on hosts and paths, then the reputation of hosts by empirical Bayes.

A page's outcome is 1 (bad) or 0. Each level shrinks its groups towards the level above: suffixes towards the rate of all
labelled pages, registered domains towards the posterior mean of their suffix, hosts towards that of their domain. How strongly
is estimated at each level from how much more the groups scatter around what is expected of them than a binomial would: the
moment estimate of the correlation rho of a beta-binomial, whose prior then weighs as much as 1 / rho - 1 pages. A host is
blocked if the lower bound of its posterior, the mean less some standard deviations, is over the rate that is put up with; so
hosts with few labelled pages are judged by their domain and suffix. Only sums are kept of any group.

Null urls and those without :// have an empty host and path, and are a host of their own without domain. Hosts that are
addresses in digits have no suffix and are their own domain; a port or user name belongs to the host but not to its domain.
Without outcomes no host is blocked. Outcomes of unknown pages or null identifiers and those other than 0 and 1 count for
nothing; a page that is labelled twice counts twice, repeated pages too. Empty tables give no rows; other columns are not read. Of rules of one length
that fit the same page, which only repeated rules can, the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, joined_to_groups, written

#: Host and path of what is always allowed or blocked.
ALLOWED = ("org/", "com/fr/")
BLOCKED = ("example.org/es/", "example.org/en/1", "com/de/")
#: Rules become one expression, so there are at most so many.
MOST_RULES = 500
#: Rate of bad pages that is put up with, and the standard deviations that the bound lies below the posterior mean.
MOST_BAD, DEVIATIONS = 0.2, 1.645
#: Prior weight in pages: a level whose groups do not differ gets the most, one whose groups are all or nothing the least.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0
#: Suffixes of more than one label under which names are registered; others are the last label.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), CAPITALS, SMALL)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, allowed: tuple[str, ...], blocked: tuple[str, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. A rule is a host, which its subdomains fit too, and
    the start of a path."""
    rules = sorted([(r, "allow") for r in allowed] + [(r, "block") for r in blocked], key=lambda r: -len(r[0]))
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    rule = verdict = F.lit(None).cast("string")
    for text, says in reversed(rules):
        of, slash, start = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def domains(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two, three = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    digits, long = bare.rlike(r"^[0-9.]+$|^\["), two.isin(*suffixes) if suffixes else F.lit(False)
    return F.when(digits, bare).when(long, three).otherwise(two), F.when(digits, "").when(long, two).otherwise(F.substring_index(bare, ".", -1))


def weight(groups: DataFrame) -> float:
    """Pages that the prior of a level weighs, from its groups (bad, pages, expected)."""
    spread = F.col("expected") * (1 - F.col("expected"))
    found = groups.agg(
        F.sum(F.pow(F.col("bad") - F.col("pages") * F.col("expected"), 2) - F.col("pages") * spread).alias("extra"), F.sum(F.col("pages") * (F.col("pages") - 1.0) * spread).alias("most")
    ).first()
    rho = found["extra"] / found["most"] if found["most"] else 0.0
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / rho - 1)) if rho > 0 else MOST_WEIGHT


def reputations(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """hosts (host, size, bad, pages) with mean and deviation of the posterior rate of bad pages. size: rows that the host has
    anywhere; pages: its labelled ones; bad: the bad ones among these. hosts is read twice: give a written table."""
    domain, suffix = domains(F.col("host"), suffixes)
    named = hosts.withColumns({"domain": domain, "suffix": suffix})
    sums = [F.sum("bad").alias("bad"), F.sum("pages").alias("pages")]
    by_domain = written(named.groupBy("domain", "suffix").agg(F.count("*").alias("below"), *sums), "domains")
    by_suffix = written(by_domain.groupBy("suffix").agg(F.count("*").alias("below"), *sums), "suffixes")
    total = by_suffix.agg(*sums).first()
    rate = (total["bad"] or 0) / total["pages"] if total["pages"] else 0.0

    def posterior(level: DataFrame, how_much: float) -> Column:
        return (F.col("expected") * how_much + F.col("bad")) / (how_much + F.col("pages"))

    level = by_suffix.withColumn("expected", F.lit(rate))
    upper = written(level.select("suffix", "below", posterior(level, weight(level)).alias("expected")), "suffixes")
    level = written(joined_to_groups(by_domain.withColumnRenamed("below", "hosts"), upper, ["suffix"], "below").drop("below"), "domains")
    dropped(by_domain, by_suffix, upper)
    lower = written(level.select("domain", "suffix", F.col("hosts").alias("below"), posterior(level, weight(level)).alias("expected")), "domains")
    level = written(joined_to_groups(named, lower, ["domain", "suffix"], "below").drop("below"), "hosts")
    much, mean = weight(level), F.col("mean")
    rated = level.withColumn("mean", posterior(level, much))
    return rated.withColumn("deviation", F.sqrt(mean * (1 - mean) / (much + F.col("pages") + 1)))


def judged(
    pages: DataFrame, outcomes: DataFrame, allowed: tuple[str, ...] = ALLOWED, blocked: tuple[str, ...] = BLOCKED, most_bad: float = MOST_BAD, deviations: float = DEVIATIONS, suffixes: tuple[str, ...] = SUFFIXES
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (allow or block), bound. pages: page_id, url; outcomes: page_id, bad (0 or
    1). The verdict is the rule's, and where no rule fits, block if bound is over most_bad."""
    host, path = parts(F.col("url"))
    read = written(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    labelled = outcomes.where("bad in (0, 1)").groupBy("page_id").agg(F.sum("bad").cast("long").alias("bad"), F.count("*").alias("pages"))
    # sums are built before rows of a host meet, so a host may hold any share of the pages
    told = read.join(labelled, "page_id").select("host", F.lit(0).cast("long").alias("size"), "bad", "pages")
    every = read.select("host", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("pages"))
    hosts = written(every.union(told).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("size", "bad", "pages"))), "hosts")
    bound = F.col("mean") - deviations * F.col("deviation")
    rated = written(reputations(hosts, suffixes).select("host", "size", bound.alias("bound")), "reputations")
    dropped(hosts)
    placed = joined_to_groups(read, rated, ["host"], "size")
    rule, verdict = ruled(F.col("host"), F.col("path"), allowed, blocked)
    own = F.when(F.col("bound") > most_bad, "block").otherwise("allow")
    return placed.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")
