"""URL filter: allow and block rules, else an empirical-Bayes host reputation.

Labelled page outcomes (1: bad) are counted by host.  The rate of a suffix is
shrunk towards the rate of all pages, that of a registered domain towards its
suffix, that of a host towards its domain, each by a beta-binomial prior whose
strength is estimated from the spread between siblings.  A page is blocked when
the lower bound of its host's posterior bad rate passes a limit; a host without
a labelled page has its prior for a posterior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlantern.llm.chosen_path import few

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ["suffix", "domain", "host"]
#: Suffixes of two labels, under which registered domains have three.
TWO_LABELS = [f"{second}.{top}" for top, seconds in {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org",
    "nz": "ac co geek gen govt iwi maori net org school", "za": "ac co gov net org web",
    "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "in": "ac co edu firm gen gov ind net org res",
    "id": "ac co go net or sch web", "il": "ac co gov net org", "th": "ac co go in net or", "ke": "ac co go ne or",
    "cn": "ac com edu gov net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org",
    "sg": "com edu gov net org per", "my": "com edu gov net org", "ph": "com edu gov net org", "vn": "com edu gov net org",
    "br": "com edu gov net org", "ar": "com edu gob gov net org", "mx": "com edu gob net org",
    "co": "com edu gov net org", "pe": "com edu gob net org", "tr": "com edu gov net org", "ua": "com edu gov net org",
    "pl": "com edu gov net org", "eg": "com edu gov net org", "sa": "com edu gov net org", "pk": "com edu gov net org",
    "ng": "com edu gov net org"}.items() for second in seconds.split()]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as (verdict, rule); null where none fits.

    A rule is (verdict, ``host/path``).  It fits its host and all subdomains of
    it when the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of, _, tail = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + tail)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _names(host: Column) -> dict[str, Column]:
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.concat_ws(".", F.slice(labels, -n, n))
    two = (F.size(labels) > 1) & last(2).isin(TWO_LABELS)
    return {"suffix": F.when(two, last(2)).otherwise(F.element_at(labels, -1)),
            "domain": F.when(two & (F.size(labels) > 2), last(3)).when(F.size(labels) > 1, last(2)).otherwise(bare)}


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior pseudo-counts by the method of moments; one number for a level."""
    s = groups.select("n", "bad", mean.alias("m")).agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).alias("s"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("v")).first()
    if not s["g"] or s["g"] < 2 or not s["v"]:
        return 1000.0
    v, free = s["v"] / s["n"], s["g"] - 1
    width = s["n"] - s["nn"] / s["n"] - free
    rho = (s["s"] - v * free) / (v * width) if width > 0 else 0.0
    return min(1000.0, max(1.0, (1 - rho) / rho)) if rho > 0 else 1000.0


def host_reputation(judged: DataFrame, asked: DataFrame) -> DataFrame:
    """(host, n, bad, alpha, beta): the posterior of every host of ``asked``, distinct hosts.

    ``judged`` holds one row per labelled page: host and bad (0 or 1).  A host
    without one has its prior, from its domain, else its suffix, else all pages.
    An empty host is none and has a row only if pages of it are labelled.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.select("*", *[c.alias(n) for n, c in _names(F.col("host")).items()])
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = (whole["bad"] or 0) / whole["n"] if whole["n"] else 0.0

    def shrunk(groups, mean, k):
        return (groups.withColumn("alpha", F.col("bad") + k * mean)
                .withColumn("beta", F.col("n") - F.col("bad") + k * (1 - mean)))

    def rate(groups, level, name):
        return groups.select(level, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias(name))

    strength = {"suffix": _strength(suffixes, F.lit(float(base)))}
    suffixes = shrunk(suffixes, F.lit(float(base)), F.lit(strength["suffix"]))
    domains = domains.join(rate(suffixes, "suffix", "above"), "suffix")
    strength["domain"] = _strength(domains, F.col("above"))
    domains = shrunk(domains, F.col("above"), F.lit(strength["domain"]))
    strength["host"] = _strength(hosts.join(rate(domains, "domain", "above"), "domain"), F.col("above"))

    every = asked.join(hosts.select("host", "n", "bad"), "host", "left").where("host <> '' or n is not null").fillna(
        0, ["n", "bad"])
    every = every.select("*", *[c.alias(n) for n, c in _names(F.col("host")).items()])
    every = every.join(rate(domains, "domain", "of_domain"), "domain", "left").join(
        few(rate(suffixes, "suffix", "of_suffix")), "suffix", "left")
    above = F.coalesce("of_domain", "of_suffix", F.lit(float(base)))
    # A level without a labelled page adds the spread between its siblings: the weakest prior on the way counts.
    k = F.when(F.col("of_domain").isNotNull(), strength["host"]).when(
        F.col("of_suffix").isNotNull(), min(strength["host"], strength["domain"])).otherwise(min(strength.values()))
    return shrunk(every, above, k).select("host", "n", "bad", "alpha", "beta")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = 0.3, z: float = 1.645,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every page.

    ``outcomes`` holds (page_id, bad) for labelled pages; rows with a null are
    left out.  Returns (page_id, host, path, rule, verdict, bad_bound): the
    verdict is the longest fitting rule's, else ``block`` if the lower bound
    (mean minus ``z`` deviations of the beta posterior) of the host's bad rate
    is over ``limit``, else ``allow``.  A host without a labelled page is
    judged by its prior alone.  Null urls have an empty host and path, and no
    bound unless pages of it are labelled; repeated rows
    are judged each; empty tables and no outcomes are fine; other columns are
    not read.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    bad = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(
        F.max(F.col("bad").cast("long")).alias("bad"))
    posterior = host_reputation(rows.select("page_id", "host").join(bad, "page_id"), rows.select("host").distinct())
    total = F.col("alpha") + F.col("beta")
    bound = F.col("alpha") / total - z * F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    bounds = posterior.select("host", bound.alias("bad_bound"))
    out = rows.join(bounds, "host", "left").withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                      F.coalesce(F.col("found.verdict"), own).alias("verdict"), "bad_bound")
