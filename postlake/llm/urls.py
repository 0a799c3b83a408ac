"""URL filter: explicit host and path rules first, then an empirical-Bayes reputation of the host.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for a url without ``://`` or null."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (action, "host/path") that fits, as struct(rule, action); else null.

    A rule fits its host and all subdomains, if the path starts with the rule's path.
    """
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(best)
    return best


def reputations(outcomes: DataFrame, z: float = 1.645, least: float = 0.001, most: float = 0.5) -> DataFrame:
    """Posterior of each host's share of bad pages, from ``outcomes`` (host, bad: 1, 0 or null if unlabelled).

    Counts (labelled, bad) of a host, its registered domain (last two labels) and its suffix (last
    label) are beta-binomial: a level's prior is its parent's posterior mean, without the group's own counts, with a
    strength estimated from how far the level's groups stray from their parents (method of moments, the
    correlation kept within ``least`` and ``most``). Returns host, n_labelled, bad_rate (posterior mean) and bad_bound
    (``z`` posterior deviations below it, 0 at least); a host without labelled pages has its domain's
    mean and a wide posterior. Pages are counted per host before any shuffle of hosts, so that a hot
    host is one row per task; three one-row sums of group counts come to the driver.
    """
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    hosts = stored(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
                   .withColumn("domain", F.regexp_extract(bare, r"([^.]+\.)?[^.]*$", 0))
                   .withColumn("suffix", F.regexp_extract(bare, r"[^.]*$", 0)), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    # what a parent with posterior (a, b) says of a group without that group's own counts
    apart = lambda a, b: (a - F.col("k")) / (a + b - F.col("n"))
    a0, b0 = F.lit((whole.k or 0) + 0.5), F.lit((whole.n or 0) - (whole.k or 0) + 0.5)

    def level(groups: DataFrame) -> DataFrame:
        """Add the posterior (a, b, mean) to groups with n, k and their parent's mean as ``up``."""
        var = F.col("up") * (1 - F.col("up"))
        got = groups.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("up"), 2)).alias("s"),
                                        F.sum(var).alias("v"), F.sum(F.col("n") * var).alias("t")).first()
        strays = (got.s - got.v) / (got.t - got.v) if got.t is not None and got.t > got.v else least
        rho = min(most, max(least, strays))
        c = (1 - rho) / rho
        return (groups.withColumn("a", F.col("k") + c * F.col("up")).withColumn("b", F.col("n") - F.col("k") + c * (1 - F.col("up")))
                .withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))))

    suffixes = level(stored(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
                            .withColumn("up", apart(a0, b0)), "suffixes"))
    domains = level(stored(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
                           .join(suffixes.select("suffix", F.col("a").alias("pa"), F.col("b").alias("pb")), "suffix")
                           .withColumn("up", apart(F.col("pa"), F.col("pb"))), "domains"))
    own = level(stored(hosts.join(domains.select("domain", F.col("a").alias("pa"), F.col("b").alias("pb")), "domain")
                       .withColumn("up", apart(F.col("pa"), F.col("pb"))), "own"))
    ab = F.col("a") + F.col("b")
    spread = F.sqrt(F.col("a") * F.col("b") / (ab * ab * (ab + 1)))
    return own.select("host", F.col("n").alias("n_labelled"), F.col("mean").alias("bad_rate"),
                      F.greatest(F.lit(0.0), F.col("mean") - z * spread).alias("bad_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url", most_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block), n_labelled, bad_bound.

    ``outcomes`` (id, bad) has labelled pages; several outcomes of one page count as one, bad if any
    is. A page that no rule fits is blocked if its host's posterior lower bound exceeds ``most_bad``.
    A null url or one without ``://`` has empty host and path and fits no rule; such pages share the
    reputation of the empty host. Null ids have no outcome; repeated rows are judged each. Other
    columns of ``pages`` are ignored.
    """
    base = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labelled = outcomes.groupBy("id").agg(F.max("bad").alias("bad"))
    ranked = reputations(base.select("id", "host").join(labelled, "id", "left").select("host", "bad"), z=z)
    hit = rule_of(F.col("host"), F.col("path"), rules)
    return (base.join(ranked, "host", "left").withColumn("hit", hit)
            .select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"),
                    F.coalesce("hit.action", F.when(F.col("bad_bound") > most_bad, "block").otherwise("allow")).alias("verdict"),
                    "n_labelled", F.round("bad_bound", 3).alias("bad_bound")))


def outcomes_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labelled outcomes from (id, quality, toxic): bad if quality is 0 or toxic is 1; null labels say nothing."""
    return labels.select(F.col(id_col).alias("id"), F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int")).alias("bad")
                         ).where("bad is not null and id is not null")
