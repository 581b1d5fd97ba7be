"""URL filters: rules of one's own first, then the reputation of hosts by empirical Bayes.

Pages with a known outcome (bad or not) are counted by host. A host's rate of bad pages is shrunk through three beta priors:
the suffix (com, co.uk) towards all pages, the registered domain towards its suffix, the host towards its domain. How strongly
a level is drawn to the one above is estimated from the data: the spread of its rates about their parents' beyond what
binomial chance gives (moments of the beta-binomial). A host is blocked if the lower bound of its posterior rate (mean less Z
standard deviations of the beta) is over LIMIT: few bad pages don't block a host, nor do those of its neighbours alone.

Counts are combined within tasks before hosts are shuffled, and a host that has a third of all pages is only a count. Verdicts
go back to the pages by a broadcast of checked size, or else by a join that deals hot hosts over several tasks.

Defined cases: a null URL, or one without ://, has an empty host and path, and the reputation that the pages of the empty host
have; a host without known outcomes has its domain's prior; a bare name or an address of digits is its own domain, with an
empty suffix; a user and a port stay in the host that rules and counts see but not in its domain; no outcomes at all: all
hosts have the prior of one bad and one good page, and none is blocked; repeated rows count as pages of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaveil.llm.common import lookup, materialise, with_columns

#: A host is blocked if its rate of bad pages is over LIMIT, Z standard deviations below the posterior mean.
LIMIT, Z = 0.5, 1.645
#: Pages that a prior may count for.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0

#: Second-level labels under which countries register domains; a domain below one of them has three labels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> F.Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str = "url") -> F.Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> F.Column:
    """The longest rule that fits: its text, else null. rules: (verdict, host and path), a short list of one's own."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith(f".{name}")) & F.col(path).startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _with_parents(hosts: DataFrame) -> DataFrame:
    """Adds suffix and domain to each host."""
    labels = F.split(F.regexp_replace("host", r"^.*@|:[0-9]*$|\.$", ""), r"\.")
    last, second = F.element_at("labels", -1), F.element_at("labels", -2)
    alone = (F.size("labels") < 2) | last.rlike("^[0-9]*$")
    deep = (F.size("labels") > 2) & (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    n = F.when(alone, 0).when(deep, 2).otherwise(1)
    taken = lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), ".")
    return (
        hosts.withColumn("labels", labels)
        .withColumn("n_suffix", n)
        .withColumn("suffix", F.when(F.col("n_suffix") == 0, F.lit("")).otherwise(taken(F.col("n_suffix"))))
        .withColumn("domain", F.when(F.col("n_suffix") == 0, F.array_join("labels", ".")).otherwise(taken(F.col("n_suffix") + 1)))
        .drop("labels", "n_suffix")
    )


def _strength(level: DataFrame) -> float:
    """Pages that the parents' rate counts for at this level (seen, bad, prior): moments of the beta-binomial."""
    variance = F.col("prior") * (1 - F.col("prior"))
    away = F.pow(F.col("bad") / F.col("seen") - F.col("prior"), 2) * F.col("seen")
    row = level.where("seen > 0").agg(F.sum(away), F.sum(variance), F.sum(variance * (F.col("seen") - 1))).first()
    if not row[2] or row[0] <= row[1]:
        return MOST_STRENGTH
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, row[2] / (row[0] - row[1]) - 1))


def _shrunk(level: DataFrame, strength: float) -> F.Column:
    return (F.col("bad") + strength * F.col("prior")) / (F.col("seen") + strength)


def reputation(hosts: DataFrame) -> DataFrame:
    """host, seen, bad, pages (a row for each host) -> with domain, suffix, rate (posterior mean) and bound (its lower bound)."""
    hosts = materialise(_with_parents(hosts), "hosts")
    counts = [F.sum("seen").alias("seen"), F.sum("bad").alias("bad")]
    domains = materialise(hosts.groupBy("suffix", "domain").agg(*counts, F.count("*").alias("n")), "domains")
    suffixes = domains.groupBy("suffix").agg(*counts, F.count("*").alias("n"))
    total = domains.agg(*counts).first()
    root = ((total["bad"] or 0) + 1) / ((total["seen"] or 0) + 2)

    suffixes = materialise(suffixes.withColumn("prior", F.lit(root)), "suffixes")
    above = suffixes.select("suffix", "n", _shrunk(suffixes, _strength(suffixes)).alias("prior"))
    domains = materialise(lookup(domains, above, "suffix", F.col("domain")), "domains")
    above = domains.select("domain", "n", _shrunk(domains, _strength(domains)).alias("prior"))
    hosts = materialise(lookup(hosts, above, "domain", F.col("host")), "hosts")
    strength = _strength(hosts)
    a, b = F.col("bad") + strength * F.col("prior"), F.col("seen") - F.col("bad") + strength * (1 - F.col("prior"))
    deviation = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return hosts.withColumn("rate", a / (a + b)).withColumn("bound", F.col("rate") - Z * deviation)


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url). outcomes: host, bad (boolean), n (pages)."""
    pages = with_columns(pages, page_id="bigint", url="string").select("page_id", host_of().alias("host"), path_of().alias("path"))
    known = with_columns(outcomes, host="string", bad="boolean", n="bigint").where("bad IS NOT NULL")
    known = known.groupBy("host").agg(F.sum("n").alias("seen"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"))
    counted = pages.groupBy("host").agg(F.count("*").alias("pages"))
    hosts = counted.join(known, "host", "left").select("host", "pages", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("seen", "bad")])
    blocked = materialise(reputation(hosts).where(F.col("bound") > limit).select("host", F.col("pages").alias("n"), F.lit("block").alias("by_host")), "blocked")
    rule = rule_of(rules)
    by_rule = F.when(F.col("rule").isin(*[r for v, r in rules if v == "allow"]), F.lit("allow")).when(F.col("rule").isNotNull(), F.lit("block"))
    judged = lookup(pages.withColumn("rule", rule), blocked, "host", F.struct("page_id", "path"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, "by_host", F.lit("allow")).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of the pages whose path names a labelled document by its number: bad if it is toxic or of quality 0."""
    number = F.regexp_extract(path_of(), "/([0-9]+)", 1).try_cast("bigint")
    named = with_columns(pages, url="string").select(host_of().alias("host"), number.alias("doc_id")).where("doc_id IS NOT NULL")
    named = named.groupBy("host", "doc_id").agg(F.count("*").alias("n"))
    marked = with_columns(labels, doc_id="bigint", quality="int", toxic="int")
    marked = marked.select("doc_id", F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1).alias("bad"))
    marked = marked.where("doc_id IS NOT NULL AND bad IS NOT NULL").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    return named.join(marked, "doc_id").select("host", "bad", "n")
