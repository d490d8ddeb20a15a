"""URL filters: explicit host-and-path rules first, empirical-Bayes host reputation for the rest.

Labelled page outcomes (bad or not) are counted by site: the host without user and port.  A site's bad rate has a beta
prior whose mean is the posterior mean of its registered domain, the domain's that of its suffix, the suffix's the rate of
all labelled pages.  A suffix is the last label, or one of ``suffixes`` of more labels; the registered domain has one label
more; an IP address is its own domain and suffix.  The weight of each prior is estimated from how much rates
differ between the groups of that level beyond binomial noise (method of moments), within ``WEIGHTS``.  A page is
blocked if the lower posterior bound of its site's bad rate, mean less ``z`` standard deviations, exceeds ``lift`` times the rate of
all labelled pages.  The default z is that of a quarter: the odds are three to one that the site is worse than pages are
at large.

All of it is column expressions: labels meet pages by id, counts are partial aggregates by site, and only three
prior weights and one rate reach the driver.  The reputations, a row for a site, are written before they meet the
pages, so that a site with a third of all pages can be split.

Nulls and edge cases: a null url, or one without ``://``, has empty host and path and the reputation of the empty
site; pages without a label count for nothing; several labels of a page count once, as bad if any is; rows alike are
rows of their own, each counted; without any label every rate is 0 and nothing is blocked by reputation; an empty
table gives an empty one; a very long url is matched once from its front.  Extra columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import stage

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least and greatest weight of a prior, in pages: the labels of a site can always outweigh what is known of others.
WEIGHTS = (1.0, 10.0)
#: Suffixes of more than one label under which names are registered (fixed values; a parameter of url_filter).
SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ng",
    "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "nhs.uk",
    "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
)
_IP = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])\z"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def site_of(host: Column) -> Column:
    """Without user, port and a final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", ""), r"\.\z", "")


def suffix_of(site: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    labels = F.split(site, r"\.", -1)
    out = F.element_at(labels, -1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        last = F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")
        out = F.when(last.isin(*[s for s in suffixes if s.count(".") + 1 == n]), last).otherwise(out)
    return F.when(F.rlike(site, F.lit(_IP)), site).otherwise(out)


def domain_of(site: Column, suffix: Column) -> Column:
    """The suffix and the label before it."""
    front = F.substring(site, F.lit(1), F.length(site) - F.length(suffix) - 1)
    return F.when(site == suffix, site).otherwise(F.concat(F.substring_index(front, ".", -1), F.lit("."), suffix))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    none = F.lit(None).cast("string")
    out = none
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def prior_weight(groups: DataFrame) -> float:
    """groups (n, k): labelled pages and bad ones of each group of a level."""
    n, k, n2, k2, g = groups.where("n > 0").agg(F.sum("n"), F.sum("k"), F.sum(F.col("n").cast("double") * F.col("n")), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")), F.count("*")).first()
    if not n or not 0 < k < n or g < 2:
        return WEIGHTS[1]
    p = k / n
    spread = k2 - n * p * p  # sum of n * (rate - p) ** 2
    between = (spread - (g - 1) * p * (1 - p)) / (n - n2 / n) if n > n2 / n else 0.0
    return WEIGHTS[1] if between <= 0 else min(max(p * (1 - p) / between - 1, WEIGHTS[0]), WEIGHTS[1])


def reputations(pages: DataFrame, labels: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, float]:
    """pages (page_id, site), labels (page_id, bad) -> (site, domain, suffix, n, k, bad_rate, sd), and the rate of all labelled pages."""
    judged = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    sites = stage(pages.join(judged, "page_id", "left").groupBy("site").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")))
    sites = sites.withColumn("suffix", suffix_of(F.col("site"), suffixes)).withColumn("domain", domain_of(F.col("site"), F.col("suffix")))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = stage(sites.groupBy("domain", "suffix").agg(*sums))
    groups = stage(domains.groupBy("suffix").agg(*sums))
    total = groups.agg(*sums).first()
    rate = (total["k"] or 0) / total["n"] if total["n"] else 0.0
    w_site, w_domain, w_suffix = prior_weight(sites), prior_weight(domains), prior_weight(groups)

    def mean(w: float, prior: Column) -> Column:
        return (F.col("k") + w * prior) / (F.col("n") + w)

    suffix_rate = groups.select("suffix", mean(w_suffix, F.lit(rate)).alias("suffix_rate"))
    domain_rate = stage(domains.join(suffix_rate, "suffix").select("domain", mean(w_domain, F.col("suffix_rate")).alias("domain_rate")))
    out = sites.join(domain_rate, "domain").withColumn("bad_rate", mean(w_site, F.col("domain_rate")))
    p, size = F.col("bad_rate"), F.col("n") + w_site
    return stage(out.withColumn("sd", F.sqrt(p * (1 - p) / (size + 1)))), rate


def url_filter(pages: DataFrame, labels: DataFrame, rules: dict[str, str], lift: float = 1.0, z: float = 0.6745, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """pages (page_id, url), labels (page_id, bad); rules: rule -> allow or block.  Per page: page_id, host,
    path, rule, verdict, n_labelled and n_bad of its site, bad_bound (the lower bound)."""
    host = host_of(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path_of(F.col("url")).alias("path"), site_of(host).alias("site"))
    known, rate = reputations(base.select("page_id", "site"), labels, suffixes)
    bound = F.col("bad_rate") - z * F.col("sd")
    known = known.select("site", bound.alias("bad_bound"), F.col("n").alias("n_labelled"), F.col("k").cast("long").alias("n_bad"))
    both = base.join(known, "site").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    says = reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(rules[r])), rules, F.when(F.lit(False), F.lit("")))
    verdict = F.coalesce(says, F.when(F.col("bad_bound") > lift * rate, F.lit("block")).otherwise(F.lit("allow")))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n_labelled", "n_bad", "bad_bound")
