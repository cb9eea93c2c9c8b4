"""URL filters: fixed rules, then the empirical-Bayes reputation of hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stage

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Suffixes of more than one label, under which domains are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn", "co.za")
MAX_BAD, Z = 0.5, 1.645


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ://."""
    found = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return lower_ascii(found(1)), found(2)


def matched(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does.

    Rules are tried longest first, in one expression: meant for lists up to some hundreds.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.find("/")
        own, rest = (text[:at], text[at:]) if at >= 0 else (text, "")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def registered(host: Column, suffixes: tuple = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; an IPv4 address is a domain of
    the suffix `ip`."""
    host = F.regexp_replace(host, r"^.*@|:[0-9]*$|[.]$", "")
    two, number = F.substring_index(host, ".", -2), host.rlike(r"^[0-9]+([.][0-9]+){3}$")
    suffix = F.when(number, F.lit("ip")).when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))
    return F.when(number, host).when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two), suffix


def _strength(units: DataFrame, parent: str, n: str, k: str) -> float:
    """The prior's weight in pages that the spread of the units' shares around their parents' asks for
    (moments of the beta-binomial); one page where no parent has two units to tell it by."""
    n, k = F.col(n).cast("double"), F.col(k).cast("double")
    of = units.groupBy(parent).agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk"), F.count(F.lit(1)).alias("u"))
    n, k = F.col("n"), F.col("k")
    s = of.agg(F.sum(n).alias("n"), F.sum("kk").alias("kk"), F.sum(k * k / n).alias("pp"), F.sum(k).alias("k"), F.sum(n - F.col("nn") / n).alias("room"), F.sum(F.col("u") - 1).alias("df")).first()
    if not s["n"] or s["room"] - s["df"] <= 0:
        return 1.0
    within = (s["k"] - s["pp"]) / s["n"]
    rho = ((s["kk"] - s["pp"]) / within - s["df"]) / (s["room"] - s["df"]) if within > 0 else 0.0
    rho = max(0.001, min(0.9, round(rho, 6)))
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, hosts: DataFrame | None = None, suffixes: tuple = SUFFIXES) -> DataFrame:
    """host, n, bad, mean, low: posterior of the share of bad pages of every host of `hosts` (column
    host; default: the labelled ones).

    outcomes: host, bad (0 or 1), a row a labelled page. The overall share is the prior of each
    suffix, a suffix's posterior mean that of its registered domains, a domain's that of its hosts;
    at each level the prior weighs as many pages as the spread of the units within their parents
    suggests. A host without labelled pages has its domain's prior, one of an unlabelled domain its
    suffix's, and so on. low is the posterior mean less Z standard deviations, which stands for the
    5 % quantile of the beta posterior.
    """
    made = outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    domain, suffix = registered(F.col("host"), suffixes)
    made = stage(made.withColumn("domain", domain).withColumn("suffix", suffix), "labelled-hosts")
    domains = stage(made.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk")), "labelled-domains")
    tops = stage(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk")).withColumn("all", F.lit(0)), "labelled-suffixes")
    whole = tops.agg(F.sum("sk"), F.sum("sn")).first()
    whole = ((whole[0] or 0) + 1) / ((whole[1] or 0) + 2)
    ms, md, mh = _strength(tops, "all", "sn", "sk"), _strength(domains, "suffix", "dn", "dk"), _strength(made, "domain", "n", "k")
    shrunk = lambda k, n, m, p: (F.coalesce(F.col(k), F.lit(0)) + m * p) / (F.coalesce(F.col(n), F.lit(0)) + m)
    every = made
    if hosts is not None:
        every = hosts.select("host").distinct().join(made.select("host", "n", "k"), "host", "left").withColumn("domain", domain).withColumn("suffix", suffix)
    every = every.join(domains.select("domain", "dn", "dk"), "domain", "left").join(tops.select("suffix", "sn", "sk"), "suffix", "left")
    every = every.withColumn("sp", shrunk("sk", "sn", ms, F.lit(whole))).withColumn("dp", shrunk("dk", "dn", md, F.col("sp")))
    every = every.na.fill(0, ["n", "k"]).withColumn("a", F.col("k") + mh * F.col("dp")).withColumn("b", F.col("n") - F.col("k") + mh * (1 - F.col("dp")))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    low = mean - Z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return every.select("host", "n", F.col("k").alias("bad"), mean.alias("mean"), low.alias("low"))


def url_filter(df: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, suffixes: tuple = SUFFIXES) -> DataFrame:
    """df's columns plus host, path, rule, verdict, bad_low.

    verdict: the rule's; without one, block if the lower posterior bound of the host's bad share
    exceeds `max_bad`, else allow. Unlabelled hosts are judged by their domain's and suffix's pages.
    outcomes: page_id, bad; ids that are null or not in df count nowhere. suffixes: those of more
    than one label under which domains are registered; any other suffix is a host's last label.

    Null url or one without ://: empty host and path, which is a host like others. Repeated rows get
    equal verdicts (labelled outcomes count once a page id and host). An empty table gives no rows.
    Columns of the names above are replaced.
    """
    df = df.drop("host", "path", "rule", "verdict", "bad_low")
    host, path = url_parts(F.col("url"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    pages = df.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("__v", verdict)
    labelled = pages.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id").groupBy("page_id", "host").agg(F.max("bad").alias("bad"))
    low = stage(host_reputation(labelled, pages, suffixes).select("host", F.col("low").alias("bad_low")), "reputations")
    judged = pages.join(low, "host", "left")
    own = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("__v", own)).drop("__v")


_STRENGTH_SQL = """SELECT (1 - r) / r AS m FROM (SELECT CASE WHEN coalesce(room - df, 0) <= 0 THEN 0.5 ELSE greatest(0.001, least(0.9, round(
  CASE WHEN k - pp > 0 THEN ((kk - pp) / ((k - pp) / n) - df) / (room - df) ELSE 0 END, 6))) END AS r
  FROM (SELECT sum(n) AS n, sum(kk) AS kk, sum(k * k / n) AS pp, sum(k) AS k, sum(n - nn / n) AS room, sum(u - 1) AS df
        FROM (SELECT sum({n})::DOUBLE AS n, sum({k})::DOUBLE AS k, sum({n} * {n})::DOUBLE AS nn,
                     sum({k}::DOUBLE * {k} / {n}) AS kk, count(*)::DOUBLE AS u FROM {t} GROUP BY {parent})))"""

URL_SQL = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(what, rule) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in RULES)}),
f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS what FROM p, r
  WHERE ('.' || host LIKE '%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY page_id),
e0 AS (SELECT host, regexp_replace(host, '^.*@|:[0-9]*$|[.]$', '', 'g') AS h FROM p GROUP BY host),
e1 AS (SELECT *, list_reverse(string_split(h, '.')) AS x, regexp_matches(h, '^[0-9]+([.][0-9]+){{3}}$') AS number FROM e0),
e2 AS (SELECT *, CASE WHEN len(x) > 1 THEN x[2] || '.' || x[1] ELSE x[1] END AS two FROM e1),
e AS (SELECT host, CASE WHEN number THEN h WHEN two IN {SUFFIXES} AND len(x) > 2 THEN x[3] || '.' || two ELSE two END AS domain,
        CASE WHEN number THEN 'ip' WHEN two IN {SUFFIXES} THEN two ELSE x[1] END AS suffix FROM e2),
l AS (SELECT page_id, host, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM p JOIN labels ON page_id = doc_id GROUP BY 1, 2),
h AS (SELECT host, domain, suffix, count(*) AS n, sum(bad) AS k FROM l JOIN e USING (host) GROUP BY ALL),
d0 AS (SELECT suffix, domain, sum(n) AS dn, sum(k) AS dk FROM h GROUP BY 1, 2),
s0 AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM d0 GROUP BY 1),
ms AS ({_STRENGTH_SQL.format(n="sn", k="sk", t="s0", parent="0 = 0")}),
md AS ({_STRENGTH_SQL.format(n="dn", k="dk", t="d0", parent="suffix")}),
mh AS ({_STRENGTH_SQL.format(n="n", k="k", t="h", parent="domain")}),
w AS (SELECT (coalesce(sum(sk), 0) + 1)::DOUBLE / (coalesce(sum(sn), 0) + 2)::DOUBLE AS w FROM s0),
c AS (SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(dn, 0) AS dn, coalesce(dk, 0) AS dk, coalesce(sn, 0) AS sn, coalesce(sk, 0) AS sk
      FROM e LEFT JOIN (SELECT host, n, k FROM h) USING (host) LEFT JOIN (SELECT domain, dn, dk FROM d0) USING (domain) LEFT JOIN s0 USING (suffix)),
s AS (SELECT *, (sk + m * w) / (sn + m) AS sp FROM c, ms, w),
d AS (SELECT s.*, (dk + md.m * sp) / (dn + md.m) AS dp FROM s, md),
b AS (SELECT host, k + mh.m * dp AS a, n - k + mh.m * (1 - dp) AS b FROM d, mh),
low AS (SELECT host, a / (a + b) - {Z} * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) AS bad_low FROM b)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.what, CASE WHEN bad_low > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (page_id) LEFT JOIN low ON p.host = low.host
"""
