"""Operator 8: URL filters with empirical-Bayes host reputation.

Rules (host, path prefix, verdict) decide the urls they fit. Their verdicts are
also labelled outcomes: every page under a rule is one trial of its host, bad
if blocked. Reputation shrinks these outcomes down the tree suffix ->
registered domain -> host: each level's share of bad pages has a beta prior
whose mean is the posterior mean of the level above it and whose strength is
fitted to the data by moments (the beta-binomial's spread over the nodes of
the level). A page that no rule fits takes the posterior of its host, or of the
nearest ancestor with outcomes, and is blocked if even the lower posterior
bound of the bad share is above the threshold: an unknown or thinly known host
is allowed.

Only DataFrame functions are used. Rules and reputations are looked up per
distinct host; pages meet them in one join on the host, whose hot keys adaptive
execution splits. Counts are combined map-side before they are shuffled.

Defined results: a null url or one without ``://`` has empty host and path,
fits no rule and is allowed; of rules that fit, the longest wins, which for one
host and path is a single rule; repeated rows are judged alike and count as
separate outcomes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import keep

LEVELS = ("suffix", "domain", "host")
RULE = "struct<rule_path:string,rule:string,rule_verdict:string>"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def parse(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))


def _rules_by_host(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``host, own``: the rules of each of ``hosts`` and its parent domains, where there are any."""
    split = [("/" + r.partition("/")[2], r, v, r.partition("/")[0].lower()) for v, r in rules]
    table = hosts.sparkSession.createDataFrame(
        split, "rule_path string, rule string, rule_verdict string, rule_host string"
    )
    labels = F.split("host", r"\.")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return (
        hosts.select("host", F.explode(ancestors).alias("rule_host"))
        .join(table, "rule_host")
        .groupBy("host")
        .agg(F.collect_list(F.struct("rule_path", "rule", "rule_verdict")).alias("own"))
    )


def match_rules(parsed: DataFrame, rules: Sequence[tuple[str, str]], scratch: str | None = None) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest fitting rule; ``rules``: (verdict, "host/path").

    The rules per host are written first: joined from a table and not from an
    aggregate, a hot host's pages can be split.
    """
    own = keep(_rules_by_host(parsed.select("host").distinct(), rules), "host-rules", scratch)
    fitting = F.filter("own", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    longest = F.reduce(
        fitting,
        F.lit(None).cast(RULE),
        lambda best, r: F.when(best.isNull() | (F.length(r["rule"]) > F.length(best["rule"])), r).otherwise(best),
    )
    fit = parsed.join(own, "host", "left").withColumn("fit", longest)
    return fit.select(*parsed.columns, F.col("fit.rule").alias("rule"), F.col("fit.rule_verdict").alias("rule_verdict"))


def _strength(own: DataFrame) -> float:
    """Prior strength of a level by moments.

    A node of n trials whose prior mean is m spreads around it by m(1-m)/n from
    sampling and by a share of m(1-m) from differing nodes; the share that
    explains the spread seen is 1 / (strength + 1).
    """
    noise = F.col("prior") * (1 - F.col("prior"))
    spread, expected, weighted = own.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)),
        F.sum(noise),
        F.sum(F.col("n") * noise),
    ).first()
    share = (spread - expected) / (weighted - expected) if weighted is not None and weighted > expected else 0.5
    share = min(max(share, 0.01), 0.99)
    return (1 - share) / share


def reputation(outcomes: DataFrame, z: float = 1.645) -> dict[str, DataFrame]:
    """Posterior of the bad share per suffix, domain and host, from ``outcomes (host, bad, n)``.

    Each level's table has its name as key column, ``mean`` and ``low``, the
    lower posterior bound ``z`` deviations below the mean.
    """
    nodes = outcomes.select("host", "bad", "n", domain_of("host").alias("domain"), suffix_of("host").alias("suffix"))
    bad, n = outcomes.agg(F.sum("bad"), F.sum("n")).first()
    tables: dict[str, DataFrame] = {}
    above = None
    for level in LEVELS:
        keys = [level] + ([above] if above else [])
        own = nodes.groupBy(*keys).agg(
            F.sum("bad").cast("double").alias("bad"), F.sum("n").cast("double").alias("n")
        )
        if above is None:
            own = own.withColumn("prior", F.lit(((bad or 0) + 1) / ((n or 0) + 2)))
        else:
            own = own.join(tables[above].select(above, F.col("mean").alias("prior")), above)
        strength = _strength(own)
        mean = (F.col("bad") + F.col("prior") * strength) / (F.col("n") + strength)
        deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))
        tables[level] = own.withColumn("mean", mean).select(
            *keys, "mean", (F.col("mean") - z * deviation).alias("low")
        )
        above = level
    return tables


def domain_of(host: str) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: str) -> Column:
    return F.substring_index(host, ".", -1)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    threshold: float = 0.5,
    z: float = 1.645,
    scratch: str | None = None,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_low`` for every row of ``pages (page_id, url)``.

    ``bad_low`` is the lower posterior bound of the bad share that the method
    went by, null where a rule decided or nothing is known.
    """
    matched = keep(match_rules(parse(pages), rules, scratch), "matched", scratch)
    outcomes = matched.groupBy("host").agg(
        F.count_if(F.col("rule_verdict") == "block").alias("bad"), F.count("rule_verdict").alias("n")
    )
    tables = reputation(keep(outcomes.filter("n > 0"), "outcomes", scratch), z)
    known = outcomes.select("host", domain_of("host").alias("domain"), suffix_of("host").alias("suffix"))
    for level in LEVELS:
        known = known.join(tables[level].select(level, F.col("low").alias(f"{level}_low")), level, "left")
    known = known.select("host", F.coalesce("host_low", "domain_low", "suffix_low").alias("low"))
    known = keep(known.filter("low is not null"), "reputation", scratch)
    low = F.when(F.col("rule").isNull(), F.col("low"))
    verdict = F.coalesce("rule_verdict", F.when(low > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return matched.join(known, "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), low.alias("bad_low")
    )
