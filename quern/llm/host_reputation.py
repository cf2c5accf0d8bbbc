"""URL filter by empirical-Bayes host reputation (native DataFrame operators only).

Labelled page outcomes are counted per host; hosts sum up to registered
domains, domains to suffixes, suffixes to the whole.  Each level's beta prior
is centred on its parent's posterior mean, with a strength fitted by moments
over the siblings of that level, so a host with few labels borrows from its
domain, and a domain from its suffix.  A host passes when the lower bound of
its posterior is at least ``bound``.

A page's outcome is the verdict of the rule that fits it (allow is good, block is
bad); pages without a rule have none, and these are the ones that the method
judges.  Outcomes of another source can be given instead.

Every level is an aggregate of the one below (partial aggregation), so a hot
host costs one row per map task.  Hosts, domains and suffixes are written once
each and read for their fit and for their posteriors; page rows meet their host's
row in one join whose hot side AQE can split.

Url null or without ``://``: host and path empty, judged like one more host.
Equally long rules that fit: the one that sorts last wins.  Repeated pages count
as often as they occur; without any outcome all hosts get the same bound; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_LOWER, ASCII_UPPER, cut

#: Suffixes of several labels, in the format of the public suffix list (``*.`` stands for any label, ``!`` marks
#: an exception); the last label alone is a suffix anyway.  A parameter: give the whole list in production.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn")
Z = 1.645
BOUND = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_parts(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain); a host without a dot is its own domain and suffix."""
    tail = lambda n: F.substring_index(host, ".", -n)
    labels = F.size(F.split(host, r"\."))
    suffix, domain = tail(1), tail(2)
    for k in range(2, max([s.count(".") + 1 for s in suffixes], default=1) + 1):
        plain = [s for s in suffixes if s[0] not in "*!" and s.count(".") == k - 1]
        stars = [s[2:] for s in suffixes if s.startswith("*.") and s.count(".") == k - 1]
        fits = (tail(k).isin(*plain) if plain else F.lit(False)) | (tail(k - 1).isin(*stars) if stars else F.lit(False))
        suffix, domain = (F.when((labels >= k) & fits, new).otherwise(old) for new, old in ((tail(k), suffix), (tail(k + 1), domain)))
    for k in sorted({s.count(".") + 1 for s in suffixes if s.startswith("!")}):
        fits = tail(k).isin(*[s[1:] for s in suffixes if s.startswith("!") and s.count(".") == k - 1])
        suffix, domain = F.when(fits, tail(k - 1)).otherwise(suffix), F.when(fits, tail(k)).otherwise(domain)
    return suffix, domain


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; rules are (action, 'host/path')."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, p = text.split("/", 1)
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _level(child: DataFrame, parent: DataFrame, key: str, up: list[str]) -> DataFrame:
    """Posterior mean and strength of each ``key`` under its parent's mean.

    The strength k is fitted over all children: with rates r = good / n and
    parent means m, the excess of sum n (r - m)^2 over binomial noise gives the
    intra-class correlation rho, and k = 1 / rho - 1, held in [1, 1000].
    """
    both = child.join(parent, up) if up else child.crossJoin(F.broadcast(parent))  # the top parent is one row
    m, n = F.col("up_mean"), F.col("n")
    fit = both.where("n > 0").agg(
        F.sum(n * F.pow(F.col("good") / n - m, 2)).alias("ss"),
        F.sum(m * (1 - m)).alias("pq"),
        F.sum((n - 1) * m * (1 - m)).alias("npq"),
    )
    rho = F.when((F.col("npq") > 0) & (F.col("ss") > F.col("pq")), (F.col("ss") - F.col("pq")) / F.col("npq")).otherwise(0.0)
    k = F.when(rho <= 0.001, 1000.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), 1 / rho - 1)))
    both = both.crossJoin(F.broadcast(fit.select(F.coalesce(k, F.lit(1000.0)).alias("k"))))
    keep = [c for c in child.columns]
    return both.select(*keep, F.col("up_mean").alias("prior_mean"), "k")


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Per host of ``outcomes`` (host, good boolean): posterior alpha and beta.

    Hosts without labels appear with n = 0 when a row has a null ``good``.
    """
    good = F.sum(F.when(F.col("good"), 1).otherwise(0)).cast("double")
    n = F.count("good").cast("double")
    suffix, domain = domain_parts(F.col("host"), suffixes)
    hosts = cut(outcomes.groupBy("host").agg(good.alias("good"), n.alias("n")).withColumns({"suffix": suffix, "domain": domain}))
    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    domains = cut(hosts.groupBy("domain", "suffix").agg(*sums))
    suffix_rows = cut(domains.groupBy("suffix").agg(*sums))
    top = suffix_rows.agg(*sums).select(((F.coalesce("good", F.lit(0.0)) + 0.5) / (F.coalesce("n", F.lit(0.0)) + 1)).alias("up_mean"))
    post = ((F.col("good") + F.col("k") * F.col("prior_mean")) / (F.col("n") + F.col("k"))).alias("up_mean")
    s = cut(_level(suffix_rows, top, "suffix", []).select("suffix", post))
    d = cut(_level(domains, s, "domain", ["suffix"]).select("domain", "suffix", post))
    h = _level(hosts, d, "host", ["domain", "suffix"])
    return h.select("host", "domain", "suffix", "n", (F.col("good") + F.col("k") * F.col("prior_mean")).alias("alpha"), (F.col("n") - F.col("good") + F.col("k") * (1 - F.col("prior_mean"))).alias("beta"))


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    outcomes: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    bound: float = BOUND,
    z: float = Z,
    suffixes: tuple[str, ...] = SUFFIXES,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, posterior_bound.

    The verdict is the rule's where one fits, else the method's.  ``outcomes``
    (page_id, good boolean) stands in for the verdicts of the rules as what the
    method learns from; an id with several counts as good when at least half are.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_u")).select("page_id", *(c.alias(n) for c, n in zip(url_parts(F.col("_u")), ("host", "path"), strict=True)))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    if outcomes is None:
        labelled = rows.select("host", (action == "allow").alias("good"))
    else:
        seen = outcomes.where(F.col("page_id").isNotNull()).groupBy("page_id").agg((F.avg(F.col("good").cast("double")) >= 0.5).alias("good"))
        labelled = rows.select("page_id", "host").join(seen, "page_id", "left").select("host", "good")
    rep = reputations(labelled, suffixes)
    a, b = F.col("alpha"), F.col("beta")
    mean = a / (a + b)
    low = mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    rep = rep.select(F.col("host").alias("_h"), F.round(low, 9).alias("posterior_bound"))
    out = rows.join(rep, F.col("host") == F.col("_h"), "left")
    method = F.when(F.col("posterior_bound") >= bound, "allow").otherwise("block")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "posterior_bound")
