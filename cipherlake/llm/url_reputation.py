"""Host reputation by empirical Bayes, and rules, for page urls.

A page's outcome is bad when the labels of the document it was made from (the
number in its path) say low quality or toxic. Each level of the host's name
(public suffix, registered domain, host) gets a posterior beta: its prior is
the posterior mean of the level above, as strong as the level's own spread
says (method of moments), and its data are the outcomes counted there. A host
is blocked when the lower bound of its posterior bad rate passes ``limit``.

Scale: outcomes are counted by host with map-side combine, the levels above
from those counts, so the large host is one row. The page table is not shuffled
where the host table is counted to be small; otherwise the join can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cipherlake.functions.storage import materialise

#: (action, host, path): a rule fits the host and its subdomains where the url's path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Host rows that are broadcast at most.
BROADCAST_HOSTS = 50_000


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


#: A public suffix: the last label, or under a country's two letters one of these before it.
SUFFIX = r"(?:(?:ac|co|com|edu|gov|ne|net|or|org)\.[a-z][a-z]|[^.]*)"


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, rf"(?:^|\.)({SUFFIX})$", 1)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    return F.regexp_extract(host, rf"(?:^|\.)((?:[^.]*\.)?{SUFFIX})$", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, action) of the longest rule that fits, null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values)])
    return pick([h + p for _, h, p in ordered]), pick([a for a, _, _ in ordered])


def _level(counts: DataFrame, prior: Column) -> DataFrame:
    """Posterior of one level from rows (n, bad, and what ``prior`` reads): columns mean and strength added.

    The strength of the prior is by moments: with rates r of groups of n pages
    and prior means m, v the n-weighted mean of (r - m)^2 and s that of m(1-m),
    v = s * (rho + (1 - rho) / n), and the strength is 1 / rho - 1.
    """
    rows = counts.withColumn("prior", prior).where("n > 0")
    rows = rows.withColumns({"gap": F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) * F.col("n"), "room": F.col("prior") * (1 - F.col("prior")) * F.col("n")})
    v, s, groups, pages = rows.agg(F.sum("gap"), F.sum("room"), F.count("*"), F.sum("n")).first()
    strength = 50.0
    if groups and groups > 1 and s:
        floor = groups / pages
        rho = min(max((v / s - floor) / max(1 - floor, 1e-9), 1e-4), 0.9)
        strength = min(max(1 / rho - 1, 1.0), 1000.0)
    k = F.lit(float(strength))
    return counts.withColumn("prior", prior).withColumn("mean", (F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).withColumn("strength", F.col("n") + k)


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, bad, mean, strength): posterior bad rate of every host of ``pages``."""
    bad = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    urls = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:[./]|$)", 1).alias("doc")).withColumn("doc_id", F.expr("try_cast(doc AS BIGINT)"))
    seen = urls.where("doc_id is not null").groupBy("host", "doc_id").agg(F.count("*").alias("k"))
    counted = seen.join(bad, "doc_id").groupBy("host").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("bad")).alias("bad"))
    hosts = urls.select("host").distinct().join(counted, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    hosts = materialise(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("bad")).first()
    overall = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _level(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), F.lit(float(overall)))
    domains = _level(domains.join(suffixes.select("suffix", F.col("mean").alias("up")), "suffix"), F.col("up"))
    return _level(hosts.join(domains.select("domain", F.col("mean").alias("up")), "domain"), F.col("up")).select("host", "n", "bad", "mean", "strength")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per row of ``pages (page_id, url)``: page_id, host, path, rule, verdict, bad_rate, bound.

    The verdict is the longest fitting rule's, else ``block`` where the lower
    posterior bound (mean less ``z`` deviations) of the host's bad rate is above
    ``limit``. A null url, or one without ``://``, has an empty host and path,
    fits no rule and is judged as the empty host. Repeated pages count as often
    as they come. Columns of ``pages`` other than page_id and url are not read.
    """
    known = materialise(reputations(pages, labels), "reputations")
    known = known.withColumn("bound", F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1)))
    small = known.count() <= BROADCAST_HOSTS
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = known.select("host", F.col("mean").alias("bad_rate"), "bound")
    out = out.join(F.broadcast(known) if small else known, "host", "left")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "bad_rate", "bound")
