"""Operator 3: empirical-Bayes reputation of hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, read

#: The contract's rules: a host (with its subdomains), the start of a path, and the verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.substring_index(F.substring_index(F.substring_index(F.substr(url, at + 3), "/", 1), "?", 1), "#", 1)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(_lower_ascii(rest))


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    at = F.instr(url, "://")
    rest = F.substring_index(F.substring_index(F.substr(url, at + 3), "?", 1), "#", 1)
    slash = F.instr(rest, "/")
    return F.when(url.isNull() | (at == 0) | (slash == 0), F.lit("")).otherwise(F.substr(rest, slash))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host + path, and its verdict; null where none fits. Longest by host, then by path."""
    found = verdict = None
    for where, start, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        found = F.when(fits, F.lit(where + start)) if found is None else found.when(fits, F.lit(where + start))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return found, verdict


#: Suffixes of two labels under which domains are registered (fixed values, from the public list); others can be passed.
PUBLIC_SUFFIXES = (
    "ac.at", "ac.id", "ac.il", "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.th", "ac.uk", "ac.za", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co", "com.eg", "com.es", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw",
    "com.ua", "com.vn", "edu.au", "edu.cn", "edu.tr", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.tr", "gov.uk", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk",
    "nhs.uk", "or.at", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.il", "org.in", "org.mx", "org.nz", "org.pl", "org.tr", "org.tw", "org.uk", "org.za", "plc.uk", "sch.uk",
)


def registered_domain(host: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    """The label before the public suffix and the suffix; an address or a host without such a label is itself."""
    bare = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(r"^[\d.]+$"), bare).when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def suffix_of(domain: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    two = F.substring_index(domain, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(domain, ".", -1))


def _prior(groups: DataFrame, by: list[str], least: float, most: float) -> DataFrame:
    """Beta-binomial prior of the groups of one level: mean and strength by moments.

    groups: by..., n, good. The mean is the pooled share m. With s2 the between-group variance of the shares, weighed by n and less its binomial part, the strength is
    m (1 - m) / s2 - 1, held between least and most. Where the groups differ no more than chance makes them, it is what their pages can tell of differences at all: N - N2 / N, the pages
    beside those of the largest group. A group that stands alone tells nothing of differences: its strength is null, for the caller to take that of the level above.
    """
    moments = groups.groupBy(*by).agg(
        F.sum("n").alias("N"), F.sum("good").alias("G"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.count(F.lit(1)).alias("K"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("Q")
    )
    m = (F.col("G") + 0.5) / (F.col("N") + 1.0)
    # sum n (share - m)^2, its expectation under no difference, and the slope of the rest in s2
    spread = F.col("Q") - F.col("G") * F.col("G") / F.col("N")
    chance = (F.col("K") - 1) * m * (1 - m)
    slope = F.col("N") - F.col("N2") / F.col("N")
    s2 = F.when((slope > 0) & (spread > chance), (spread - chance) / slope)
    held = lambda x: F.least(F.greatest(x, F.lit(least)), F.lit(most))
    strength = F.when(F.col("K") > 1, F.when(s2.isNull(), held(slope)).otherwise(held(m * (1 - m) / s2 - 1)))
    return moments.select(*by, m.alias("mean"), F.round(strength, 6).alias("strength"))


def reputations(outcomes: DataFrame, least: float = 1.0, most: float = 1000.0, z: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """outcomes (host, n, good): labelled pages of each host -> (hosts, domains, suffixes), each with its posterior mean and bound.

    Priors go down the levels: all labelled pages give the prior of suffixes, a suffix that of its registered domains, a domain that of its hosts. A level's posterior mean is
    (strength * prior mean + good) / (strength + n), and what goes down from it leaves out the child's own pages, so that none counts twice; a host with few labelled pages keeps near its domain. A host that
    is its domain's only one is judged as that domain, with the strength of the level above, and so is an only domain of a suffix. bound is the posterior mean less z posterior standard deviations, 0 at least; of a domain or suffix it is the bound of a host in it that has no labelled page. Each level is summed before it is joined.
    """
    named = outcomes.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    hosts = named.groupBy("suffix", "domain", "host").agg(F.sum("n").cast("double").alias("n"), F.sum("good").cast("double").alias("good"))
    hosts = materialize(hosts, "hosts")
    domains = materialize(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "suffixes")
    top = _prior(suffixes.withColumn("one", F.lit(1)), ["one"], least, most).select("one", F.col("mean").alias("m0"), F.coalesce("strength", F.lit(least)).alias("k0"))
    of_domains = _prior(domains, ["suffix"], least, most).select("suffix", F.col("strength").alias("k1"))
    of_hosts = _prior(hosts, ["domain"], least, most).select("domain", F.col("strength").alias("k2"))
    c = F.col
    below = lambda mean, sd_weight: F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (sd_weight + 1)))
    s = suffixes.withColumn("one", F.lit(1)).join(F.broadcast(top), "one").join(of_domains, "suffix").select("suffix", "m0", "k0", F.coalesce("k1", "k0").alias("k1"), c("n").alias("s_n"), c("good").alias("s_good"))
    s = materialize(s.withColumn("s_mean", (c("k0") * c("m0") + c("s_good")) / (c("k0") + c("s_n"))).withColumn("s_bound", below(c("s_mean"), F.least("k0", "k1"))), "suffixes")
    d = domains.join(s, "suffix").join(of_hosts, "domain").withColumn("m1", (c("k0") * c("m0") + c("s_good") - c("good")) / (c("k0") + c("s_n") - c("n")))
    d = d.select("domain", "suffix", "m1", "k1", F.coalesce("k2", "k1").alias("k2"), c("n").alias("d_n"), c("good").alias("d_good"))
    d = materialize(d.withColumn("d_mean", (c("k1") * c("m1") + c("d_good")) / (c("k1") + c("d_n"))).withColumn("d_bound", below(c("d_mean"), F.least("k1", "k2"))), "domains")
    h = hosts.join(d.drop("suffix"), "domain").withColumn("m2", (c("k1") * c("m1") + c("d_good") - c("good")) / (c("k1") + c("d_n") - c("n")))
    mean = (c("k2") * c("m2") + c("good")) / (c("k2") + c("n"))
    known = h.select("host", "domain", "suffix", "n", "good", mean.alias("mean"), below(mean, c("k2") + c("n")).alias("bound"))
    return materialize(known, "known"), d.select("domain", "d_mean", "d_bound"), s.select("suffix", "s_mean", "s_bound")


def judge_urls(pages: DataFrame, outcomes: DataFrame, least_bound: float = 0.7, rules=RULES, most_broadcast: int = 200_000) -> DataFrame:
    """pages (page_id, url, ...) -> host, path, rule, verdict, mean, bound added, a row for each row of pages, repeated ones too.

    A rule's verdict wins; else the page is allowed if the lower posterior bound of its host reaches least_bound. A host without labelled pages is judged by its domain, then by its suffix; where none has
    labels, or there are no outcomes at all, the page is blocked. Null and unparsable urls have empty host and path and no labels; long urls are read whole; an empty table gives no rows. Statistics come
    from every labelled page. Each distinct host is judged once; up to most_broadcast hosts go to every task, beyond that the join shuffles and Spark splits hot hosts. Columns named as the added ones are replaced.
    """
    fields = ["host", "path", "rule", "verdict", "mean", "bound"]
    parsed = pages.drop(*fields).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known, by_domain, by_suffix = reputations(outcomes)
    hosts = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    judged = (
        hosts.join(known.select("host", "mean", "bound"), "host", "left")
        .join(by_domain, "domain", "left")
        .join(by_suffix, "suffix", "left")
        .select("host", F.coalesce("mean", "d_mean", "s_mean", F.lit(0.5)).alias("mean"), F.coalesce("bound", "d_bound", "s_bound", F.lit(0.0)).alias("bound"))
    )
    judged = materialize(judged, "judged")
    return (
        parsed.join(F.broadcast(judged) if judged.count() <= most_broadcast else judged, "host", "left")
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.round("bound", 9) >= least_bound, "allow").otherwise("block")))
    )


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pages of each host: a page's label is that of the document with its number, good where quality is 1 and toxic is 0."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    return pages.select("page_id", host_of(F.col("url")).alias("host")).join(one, F.col("page_id") == F.col("doc_id")).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, labelled_outcomes(pages, read(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")
