"""Empirical-Bayes reputation of hosts: beta-binomial shrinkage from host to registered domain to suffix. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK))
#: Public suffixes of two labels, under which names are registered one label further left; extend it for more.
SUFFIXES: tuple[str, ...] = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.sg", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
_ADDRESS = r"^(\d+\.\d+\.\d+\.\d+|\[.*)$"
#: A page's own labels count with this prior weight where the data fix none, and no less than LEAST, no more than MOST.
LEAST, MOST = 2.0, 1000.0


def _rest(url: Column) -> Column:
    """What stands behind the first ``://``; empty where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1)


def _name(host: Column) -> Column:
    """A host without its port."""
    return F.regexp_replace(host, r":\d*$", "")


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix: two labels if they are among ``suffixes`` and a third stands before them, else the last; ``address`` for numeric hosts."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), F.lit("address")).when(two.isin(*suffixes) & (name != two), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it; a numeric host is its own."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule (host and path together) that fits, as ``struct<rule, verdict>``; null if none does."""
    tests = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        tests = F.when(fits, value) if tests is None else tests.when(fits, value)
    return tests if tests is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(groups: DataFrame) -> float:
    """The prior weight that the groups' spread around their parents' rates calls for, by the method of moments."""
    p, n = F.col("parent_rate"), F.col("n")
    found = groups.agg(F.sum(F.pow(F.col("good") - n * p, 2) - n * p * (1 - p)), F.sum(n * (n - 1) * p * (1 - p))).first()
    rho = found[0] / found[1] if found[1] else 0.0  # intraclass correlation: the weight is 1 / rho - 1
    return max(LEAST, min(MOST, 1 / rho - 1)) if rho > 0 else MOST


def host_reputation(outcomes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``host, n, good, rate, sd`` of each host from labelled outcomes (``host``, ``good`` 0 or 1), and of each in ``asked``.

    A suffix's rate is shrunk to the whole table's, a registered domain's (see ``domain_of``) to its suffix's,
    and a host's to its domain's; each level's prior weight is fitted to that level. ``rate`` and ``sd`` are mean
    and deviation of the host's beta posterior. Rows with a null host or outcome don't count. A host of ``asked``
    (``host``) without outcomes has ``n`` 0 and the rate of its domain, else its suffix, else the whole table, with
    the hosts' prior weight; without any outcome at all there is no row.
    """
    hosts = outcomes.filter("host is not null and good is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("double").alias("good"))
    hosts = written(hosts, "hosts").select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "good")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    good, n = suffixes.agg(F.sum("good"), F.sum("n")).first()

    def shrunk(groups: DataFrame, rate: str) -> tuple[DataFrame, float]:
        weight = _strength(groups)
        return groups.withColumn(rate, (F.col("good") + weight * F.col("parent_rate")) / (F.col("n") + weight)), weight

    whole = ((good or 0) + 1) / ((n or 0) + 2)
    suffixes, _ = shrunk(suffixes.withColumn("parent_rate", F.lit(whole)), "suffix_rate")
    domains, _ = shrunk(domains.join(suffixes.select("suffix", F.col("suffix_rate").alias("parent_rate")), "suffix"), "domain_rate")
    hosts, weight = shrunk(hosts.join(domains.select("domain", F.col("domain_rate").alias("parent_rate")), "domain"), "rate")
    hosts = hosts.select("host", "n", "good", "rate")
    if asked is not None and n:
        new = asked.filter("host is not null").select("host").distinct().join(hosts, "host", "left_anti")
        new = new.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
        new = new.join(domains.select("domain", "domain_rate"), "domain", "left").join(suffixes.select("suffix", "suffix_rate"), "suffix", "left")
        hosts = hosts.unionByName(new.select("host", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("good"), F.coalesce("domain_rate", "suffix_rate", F.lit(whole)).alias("rate")))
    return hosts.withColumn("sd", F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + weight + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, least_rate: float = 0.8, z: float = 1.645) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's ``rate, bound``.

    A rule's verdict stands; otherwise a page is blocked if even the upper posterior bound, ``rate + z sd`` of its
    host, lies below ``least_rate``. Hosts without outcomes are judged by their domain, suffix or the whole table;
    only where there is no outcome at all they have no bound and are allowed. A null url, or one without ``://``,
    has an empty host and path. ``outcomes`` has ``url`` and ``good``. Repeated pages each give a row, and an empty
    table none.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = host_reputation(outcomes.select(host_of(F.col("url")).alias("host"), F.col("good")), rows)
    scored = scored.select("host", "rate", (F.col("rate") + z * F.col("sd")).alias("bound"))
    rows = rows.withColumn("_m", matched_rule(F.col("host"), F.col("path"), rules)).join(scored, "host", "left")
    own = F.when(F.col("bound") < least_rate, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return rows.select("page_id", "host", "path", F.col("_m.rule").alias("rule"), F.coalesce("_m.verdict", own).alias("verdict"), F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The quality label of the document that a page shows (same id) is the outcome of its url."""
    found = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("good")).filter("_id is not null and good is not null")
    return pages.select("page_id", "url").join(found, F.col("page_id") == F.col("_id")).select("url", "good")
