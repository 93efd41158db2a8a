"""Operator 7: URL filtering by rules and empirical-Bayes host reputation.

Rules decide the pages that they fit. Their outcomes are the labels, and so are the pages of a host that rules are written for but that
none of them touches: whoever wrote ``net/es/`` had the other paths of ``net`` before them and did not block these. Without them
a host under a blocking rule would have bad labels only, however small the part of it that is blocked. A host's share of blocked pages
has a beta posterior from its own labelled pages and a prior. The prior comes from the other hosts of its
registered domain, theirs from the other domains of its suffix, theirs from all pages: at
each level the host's own part is left out, so no page counts twice. How strongly a level shrinks follows from
the spread of the shares below it inside each parent (method of moments), and is at most the number of
labelled groups that the estimate rests on; a prior never counts for more pages than it was learnt from.

A page without a rule is blocked if the chance of its host's share to lie above the cut is greater than
``sure``, and only if the host or another host of its domain has labelled pages: a suffix alone blocks nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._exec import join_unique, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # allow or block, host, path
#: Frequent suffixes of two labels, below which domains are registered.
TWO_LABEL = ["ac.at", "co.at", "or.at", "com.au", "net.au", "org.au", "com.br", "net.br", "org.br", "com.cn", "net.cn", "org.cn", "com.hk", "co.id", "co.il", "co.in", "ac.jp", "co.jp", "ne.jp", "or.jp", "co.kr", "com.mx", "com.my", "co.nz", "net.nz", "org.nz", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "ac.uk", "co.uk", "gov.uk", "org.uk", "co.za"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string), and its action; nulls if none does."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def covered(host: Column, rules: list[Rule]) -> Column:
    """Whether some rule is written for the host or a domain above it, whatever the path."""
    fits = F.lit(False)
    for h in sorted({h for _, h, _ in rules}):
        fits = fits | (host == h) | host.endswith("." + h)
    return fits


def levels(host: Column, two_label: list[str]) -> tuple[Column, Column]:
    """Registered domain and suffix; ``two_label`` suffixes (like co.uk) count as one.

    The port does not count. IPv4 addresses and hosts of one label are their own domain and have the suffix "".
    """
    name = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n), ".")
    two = last(2).isin(two_label) if two_label else F.lit(False)
    own = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | ~name.contains(".") | (two & (F.size(labels) == 2))
    return F.when(own, name).when(two, last(3)).otherwise(last(2)), F.when(own, "").when(two, last(2)).otherwise(last(1))


def beta_above(a: np.ndarray, b: np.ndarray, cut: float) -> np.ndarray:
    """The chance of a Beta(a, b) variable to be above ``cut`` (0 < cut < 1), by the continued fraction of the incomplete beta function."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    swap = cut > (a + 1) / (a + b + 2)  # where the fraction converges fast
    p, q, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - cut, cut)
    log = np.array([math.lgamma(i + j) - math.lgamma(i) - math.lgamma(j) for i, j in zip(p.tolist(), q.tolist(), strict=True)])
    front = np.exp(log + p * np.log(x) + q * np.log1p(-x)) / p
    value, c, d = np.ones(len(p)), np.ones(len(p)), np.zeros(len(p))  # 1 + t1 / (1 + t2 / (1 + ...))
    left, j = np.arange(len(p)), 1
    safe = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    while len(left):
        pl, ql, xl, m = p[left], q[left], x[left], j // 2
        t = -(pl + m) * (pl + ql + m) * xl / ((pl + 2 * m) * (pl + 2 * m + 1)) if j % 2 else m * (ql - m) * xl / ((pl + 2 * m - 1) * (pl + 2 * m))
        d[left] = 1 / safe(1 + t * d[left])
        c[left] = safe(1 + t / c[left])
        value[left] *= c[left] * d[left]
        left = left[np.abs(c[left] * d[left] - 1) > 1e-14]
        j += 1
    below = np.clip(front / value, 0, 1)
    return np.where(swap, below, 1 - below)


def _moments(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """One row with the strength of a level's prior: from the spread of its groups' shares inside their parents."""
    n, k = F.col("n"), F.col("k")
    each = children.where("n > 0").groupBy(*parent).agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count("*").alias("g"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk"))
    p = F.col("k") / F.col("n")
    sums = each.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(x) for x, c in (("s", F.col("kk") - F.col("k") * p), ("l", p * (1 - p) * (F.col("g") - 1)), ("r", p * (1 - p) * (F.col("n") - F.col("nn") / F.col("n"))), ("g", F.col("g").cast("double")))))
    most = F.greatest(F.lit(2.0), F.col("g"))
    rho = (F.col("s") - F.col("l")) / (F.col("r") - F.col("l"))
    m = F.when(F.col("r") <= F.col("l") + 1e-12, most).when(rho <= 0, most).otherwise(F.least(most, F.greatest(F.lit(0.5), (1 - rho) / rho)))
    return sums.select(m.alias(name))


def reputation(outcomes: DataFrame, two_label: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """Rows (host, pages, n, n_domain, a, b, mean, above): the posterior of the share of bad pages of each host.

    ``outcomes`` has (host, bad): one row for each page, ``bad`` 0, 1 or null (not labelled). ``n`` and
    ``n_domain`` are the labelled pages of the host and of its domain, Beta(a, b) is the posterior,
    ``above`` the chance of a share above ``cut``. Hosts without labels get their prior. Empty input gives an empty result.
    """
    domain, suffix = levels(F.col("host"), TWO_LABEL if two_label is None else two_label)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    hosts = saved(outcomes.where("host is not null").groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), total("bad").alias("k")).withColumn("domain", domain).withColumn("suffix", suffix))
    domains = hosts.groupBy("domain", "suffix").agg(total("n").alias("n"), total("k").alias("k"), F.count("*").alias("hosts"))
    suffixes = saved(domains.groupBy("suffix").agg(total("n").alias("n"), total("k").alias("k"), F.count("*").alias("domains")))
    every = suffixes.agg(total("n").alias("n_all"), total("k").alias("k_all"))
    one = _moments(suffixes.withColumn("all", F.lit(1)), ["all"], "ms").crossJoin(_moments(domains, ["suffix"], "md")).crossJoin(_moments(hosts, ["domain", "suffix"], "mh")).crossJoin(every).first()
    ms, md, mh = one["ms"], one["md"], one["mh"]
    overall = (one["k_all"] + 0.5) / (one["n_all"] + 1)
    s = suffixes.select("suffix", F.col("n").alias("ns"), F.col("k").alias("ks"), "domains")
    d = join_unique(domains.select("domain", "suffix", F.col("n").alias("nd"), F.col("k").alias("kd"), "hosts"), s, ["suffix"], "domains")
    # Of the suffix without the domain; its strength is bounded by the pages that it was learnt from.
    mean_s = (F.col("ks") - F.col("kd") + ms * overall) / (F.col("ns") - F.col("nd") + ms)
    d = saved(d.select("domain", "suffix", "nd", "kd", "hosts", mean_s.alias("ps"), F.least(F.lit(md), (F.col("ns") - F.col("nd")).cast("double")).alias("md")))
    h = join_unique(hosts, d, ["domain", "suffix"], "hosts")
    others = F.col("nd") - F.col("n") + F.col("md")
    prior = F.when(others > 0, (F.col("kd") - F.col("k") + F.col("md") * F.col("ps")) / others).otherwise(F.col("ps"))
    h = h.withColumn("m", F.least(F.lit(mh), others)).withColumn("p", prior)
    h = h.select("host", "pages", "n", F.col("nd").alias("n_domain"), (F.col("k") + F.col("m") * F.col("p") + 0.5).alias("a"), (F.col("n") - F.col("k") + F.col("m") * (1 - F.col("p")) + 0.5).alias("b"))

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(a / (a + b)), pa.array(beta_above(a, b, cut))], [*t.schema.names, "mean", "above"])

    return h.mapInArrow(chance, "host string, pages bigint, n bigint, n_domain bigint, a double, b double, mean double, above double")


def judge_urls(pages: DataFrame, rules: list[Rule], cut: float = 0.5, two_label: list[str] | None = None, sure: float = 0.95) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, posterior), one for each row of ``pages`` (page_id, url).

    ``posterior`` is the host's mean share of blocked pages. A null url, or one without
    ``://``, has an empty host and path and is judged like a host of its own. Rows are never
    dropped; nulls in page_id and repeated rows pass through, other columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("action", action)
    bad = F.coalesce((F.col("action") == "block").cast("int"), F.when(covered(F.col("host"), rules), 0))
    known = reputation(ruled.select("host", bad.alias("bad")), two_label, cut)
    own = F.when((F.col("above") > sure) & (F.col("n_domain") > 0), "block").otherwise("allow")
    by_host = saved(known.select("host", F.col("mean").alias("posterior"), own.alias("own"), "pages"))
    return join_unique(ruled, by_host, ["host"], "pages").select("page_id", "host", "path", "rule", F.coalesce("action", "own").alias("verdict"), "posterior")
