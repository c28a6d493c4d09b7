"""URL verdicts: fixed host and path rules first, then an empirical-Bayes reputation of the host."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage

# rule, verdict
Rule = tuple[str, str]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; a null url or one without ``://`` has both empty."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    df = df.withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return df.withColumn("host", lower_ascii(F.col("_host"))).withColumn("path", path).drop("_rest", "_host")


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits ``host`` and ``path``, else null.

    A rule ``host/path`` fits its host and the subdomains where the path starts with the rule's.  The
    list is a parameter of the job (tens of rules), not a table.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def with_levels(df: DataFrame, suffixes: list[str]) -> DataFrame:
    """Add ``domain`` (suffix and one label more) and ``suffix``.

    ``suffixes`` are the public suffixes of more than one label; any other host ends in its last label.
    """
    found = F.substring_index("host", ".", -1)
    for s in sorted(suffixes, key=len):
        found = F.when((F.col("host") == s) | F.col("host").endswith("." + s), F.lit(s)).otherwise(found)
    df = df.withColumn("suffix", found)
    labels = F.size(F.split("suffix", r"\.")) + 1
    tail = F.slice(F.reverse(F.split("host", r"\.")), F.lit(1), labels)
    return df.withColumn("domain", F.array_join(F.reverse(tail), "."))


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level: moment estimate of the beta-binomial overdispersion around ``p``.

    ``groups`` has trials ``n``, bad outcomes ``k`` and the mean ``p`` of the parent.  One row comes back.
    """
    z = (F.col("k") / F.col("n") - F.col("p"))
    row = groups.where("n > 0").agg(
        F.sum(F.col("n") * z * z / (F.col("p") * (1 - F.col("p")))).alias("s"),
        F.sum("n").alias("n"), F.count("*").alias("g")).first()
    if not row.g or row.n <= row.g:
        return 10.0
    rho = min(max((row.s - row.g) / (row.n - row.g), 1e-3), 0.9)
    return round(1 / rho - 1, 6)


def host_reputation(outcomes: DataFrame, hosts: DataFrame, suffixes: list[str], z: float = 1.645) -> DataFrame:
    """Posterior of the bad rate of each host.

    ``outcomes``: ``host``, ``bad`` (0/1) of labelled pages; ``hosts``: distinct ``host`` to judge.
    Counts are added up once by host and rolled up to registered domain and suffix.  The corpus rate,
    with one bad and one good page added, is the prior mean of a suffix, the posterior mean of the
    suffix that of its domains and that of the domain that of its hosts; each level's strength is
    fitted by moments.  Returns ``host``, ``n``, ``mean``, ``low``, ``high``: mean and normal credible
    bounds.  A host without outcomes gets its parents' mean and wide bounds; without any outcomes the
    corpus rate is one half.
    """
    counts = outcomes.where("bad is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum("bad").cast("long").alias("k"))
    base = cut_lineage(with_levels(hosts.join(counts, "host", "left").fillna(0, ["n", "k"]), suffixes))
    domains = base.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = tops.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = ((total.k or 0) + 1) / ((total.n or 0) + 2)

    def posterior(level: DataFrame, keep: list[str], mean: str) -> DataFrame:
        s = _strength(level)
        return level.select(*keep, ((F.col("k") + s * F.col("p")) / (F.col("n") + s)).alias(mean),
                            (F.col("n") + s).alias("_weight"))

    tops = posterior(tops.withColumn("p", F.lit(rate)), ["suffix"], "p").drop("_weight")
    domains = posterior(domains.join(tops, "suffix"), ["domain"], "p").drop("_weight")
    out = posterior(base.join(domains, "domain"), ["host", "n"], "mean")
    half = z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("_weight") + 1))
    return out.select("host", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], suffixes: list[str],
               limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """Verdict for each page: ``page_id, host, path, rule, verdict, bad_rate, bad_low``.

    ``outcomes`` has ``page_id``, ``bad`` for labelled pages; a null or unmatched one is no evidence and
    repeated rows count each time.  A rule decides alone; else the page is blocked if the lower credible
    bound of its host's bad rate exceeds ``limit``.  Null ids, empty and repeated urls keep their rows,
    extra columns are not read, no pages give no rows.  A host with a third of all pages is one row after
    map-side combine; joining it back is a plain equi-join, which adaptive execution splits.
    """
    urls = with_host_and_path(pages.select("page_id", "url"))
    seen = urls.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id")
    reputation = host_reputation(seen, urls.select("host").distinct(), suffixes, z)
    name, verdict = rule_columns(rules)
    out = urls.join(reputation, "host", "left").withColumn("rule", name)
    own = F.when(F.col("low") > limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, own).alias("verdict"),
                      F.col("mean").alias("bad_rate"), F.col("low").alias("bad_low"))
