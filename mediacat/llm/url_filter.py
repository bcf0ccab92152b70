"""URL filtering by rules, then by empirical-Bayes host reputation.

Reputation is a beta-binomial model in three levels. Labelled outcomes of pages (good or
bad) are counted for each host, and the counts are summed to its registered domain and to
its suffix. A level's prior is Beta(strength * p, strength * (1 - p)) with p the posterior
mean of the level above it (of the whole table above the suffix), so a host with few pages
leans on its domain and a domain with few on its suffix. The strength of a level is fitted
to the corpus by the method of moments. A page is allowed if the upper posterior bound of
its host's share of good pages, mean + z * standard deviation, reaches the threshold.

Rules come first: a rule (host, path) fits the host and its subdomains where the url's path
starts with the rule's path; the longest rule that fits decides.

The levels are those of the host without user info, port and final dots. The suffix is the
last label, or the last two where they are listed (`suffixes`, public suffixes of two labels);
the registered domain has one label more. A numeric address is its own domain under the
suffix 'ip'.

Counts are partial sums before any exchange, so a hot host sends one row for each task; the
hosts' counts are stored once for all levels. Bounds are broadcast while the hosts are few,
else pages are salted, so a hot host is no one task. All steps are DataFrame expressions.

Defined cases: a null url or one without '://' has an empty host and path and is judged as
that empty host; very long urls are read whole; a page without labelled outcome only leans on
the levels above; with no outcome at all every page has the neutral share one half; equally
long rules can only be the same one; repeated rows are judged alike; an empty table gives no
rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import stored, table

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A host is blocked if even this many deviations above its mean lie under the threshold.
BOUND_Z, MIN_GOOD = 1.0, 0.8
# Common public suffixes of two labels.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp",
    "co.kr", "or.kr", "co.in", "net.in", "org.in", "com.br", "org.br", "net.br", "gov.br", "com.cn", "net.cn", "org.cn", "gov.cn", "com.tw", "org.tw", "com.hk", "com.sg", "com.my",
    "co.id", "co.th", "com.vn", "com.ph", "com.mx", "org.mx", "com.ar", "com.co", "com.pe", "com.ve", "com.tr", "org.tr", "co.za", "org.za", "co.il", "org.il", "com.eg", "com.sa",
    "com.ua", "com.pl", "com.es", "com.pt", "com.gr", "co.at", "or.at",
)
#: Hosts up to which their bounds are broadcast, and copies of a bound beyond.
BROADCAST_HOSTS, SALTS = 500_000, 32
#: Bounds on the fitted prior strengths, in pages.
STRENGTH = (2.0, 1000.0)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """The host without user info, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")


def levels(site: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host (see `site_of`)."""
    one, two, three = (F.substring_index(site, ".", -k) for k in (1, 2, 3))
    address = F.rlike(site, F.lit(r"^([0-9]+([.][0-9]+){3}|\[.*)$"))
    listed = two.isin(list(suffixes))
    return F.when(address, site).when(listed, three).otherwise(two), F.when(address, F.lit("ip")).when(listed, two).otherwise(one)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits; null where none does."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.greatest(*fits) if len(fits) > 1 else (fits[0] if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>"))


def _strength(units: DataFrame) -> Column:
    """A scalar subquery: the beta-binomial strength of a level from the analysis of variance of its units."""
    n, good = F.col("n").cast("double"), F.col("good").cast("double")
    sums = units.filter("n > 0").agg(F.sum(n).alias("N"), F.sum(n * n).alias("N2"), F.sum(good).alias("G"), F.count(F.lit(1)).alias("k"), F.sum(good * good / n).alias("S"))
    s = {c: F.col(c) for c in ("N", "N2", "G", "k", "S")}
    between = (s["S"] - s["G"] * s["G"] / s["N"]) / (s["k"] - 1)
    within = (s["G"] - s["S"]) / (s["N"] - s["k"])
    size = (s["N"] - s["N2"] / s["N"]) / (s["k"] - 1)
    rho = (between - within) / (between + (size - 1) * within)
    low, high = map(F.lit, STRENGTH)
    # one unit, or one page in each: no spread to fit, the level above decides
    fitted = F.when((s["k"] > 1) & (s["N"] > s["k"]), F.when(between > within, F.least(high, F.greatest(low, 1 / rho - 1))).otherwise(high)).otherwise(high)
    return sums.select(fitted.alias("m")).scalar()


def reputation(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, mean and deviation of the posterior share of good pages; hosts: host (see `site_of`), n, good (longs)."""
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    p0 = ends.agg(F.coalesce((F.sum("good") + 0.5) / (F.sum("n") + 1), F.lit(0.5)).alias("p")).scalar()
    shrunk = lambda prior, m: (F.col("good") + m * prior) / (F.col("n") + m)
    s = ends.withColumn("m", _strength(ends)).select("suffix", shrunk(p0, F.col("m")).alias("p1"))
    d = domains.join(s, "suffix").withColumn("m", _strength(domains)).select("domain", shrunk(F.col("p1"), F.col("m")).alias("p2"))
    hosts = hosts.withColumn("m3", _strength(hosts))
    a, b = F.col("good") + F.col("m3") * F.col("p2"), F.col("n") - F.col("good") + F.col("m3") * (1 - F.col("p2"))
    return hosts.join(d, "domain").select("host", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def _with_bounds(urls: DataFrame, bounds: DataFrame, n: int) -> DataFrame:
    """urls with the bound of their site; bounds: site, bound, n rows."""
    if n <= BROADCAST_HOSTS:
        return urls.join(F.broadcast(bounds), "site")
    copies = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return urls.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(copies, ["site", "salt"]).drop("salt")


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, z: float = BOUND_Z, min_good: float = MIN_GOOD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the bound that the method judges by.

    pages: page_id, url. outcomes: page_id, good (boolean), one row for each labelled page;
    of repeated ones the worst counts.
    """
    urls = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("site", site_of(F.col("host")))
    known = outcomes.filter("good is not null").groupBy("page_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    hosts = stored(urls.join(known, "page_id", "left").groupBy(F.col("site").alias("host")).agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good")))
    bounds = reputation(hosts, suffixes).select(F.col("host").alias("site"), F.least(F.lit(1.0), F.col("mean") + z * F.col("deviation")).alias("bound"))
    judged = _with_bounds(urls.withColumn("fit", matched_rule(F.col("host"), F.col("path"), rules)), bounds, hosts.count())
    verdict = F.coalesce("fit.verdict", F.when(F.col("bound") >= min_good, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.round("bound", 6).alias("bound"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality label of the record that shares a page's id, the labels there are."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    return judge(table(spark, sf_dir, "pages"), labels)


def _level(name: str, units: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN k > 1 AND N > k AND msb > msw THEN least({STRENGTH[1]}::DOUBLE, greatest({STRENGTH[0]}::DOUBLE, 1 / ((msb - msw) / (msb + (n0 - 1) * msw)) - 1)) ELSE {STRENGTH[1]}::DOUBLE END AS {name}
  FROM (SELECT k, N, CASE WHEN k > 1 THEN (S - G * G / N) / (k - 1) END AS msb, CASE WHEN N > k THEN (G - S) / (N - k) END AS msw, CASE WHEN k > 1 THEN (N - N2 / N) / (k - 1) END AS n0
    FROM (SELECT sum(n::DOUBLE) AS N, sum(n::DOUBLE * n) AS N2, sum(good::DOUBLE) AS G, count(*) AS k, sum(good::DOUBLE * good / n) AS S FROM {units} WHERE n > 0)))"""


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL = {
    "op9_url_filter": f"""
WITH urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
sites AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS site FROM urls),
known AS (SELECT doc_id AS page_id, min((quality = 1)::INTEGER) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
named AS (SELECT *, string_split(host, '.') AS l, regexp_matches(host, '^([0-9]+([.][0-9]+){{3}}|\\[.*)$') AS address
  FROM (SELECT site AS host, count(good)::BIGINT AS n, coalesce(sum(good), 0)::BIGINT AS good FROM sites LEFT JOIN known USING (page_id) GROUP BY site)),
listed AS (SELECT *, array_to_string(list_slice(l, -2, -1), '.') IN {SUFFIXES} AS long FROM named),
hosts AS (SELECT host, n, good, CASE WHEN address THEN host ELSE array_to_string(list_slice(l, CASE WHEN long THEN -3 ELSE -2 END, -1), '.') END AS domain,
  CASE WHEN address THEN 'ip' ELSE array_to_string(list_slice(l, CASE WHEN long THEN -2 ELSE -1 END, -1), '.') END AS suffix FROM listed),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM domains GROUP BY ALL),
{_level("m1", "suffixes")}, {_level("m2", "domains")}, {_level("m3", "hosts")},
p AS (SELECT coalesce((sum(good) + 0.5) / (sum(n) + 1), 0.5)::DOUBLE AS p0 FROM suffixes),
s AS (SELECT suffix, (good + m1 * p0) / (n + m1) AS p1 FROM suffixes, p, m1),
d AS (SELECT domain, (good + m2 * p1) / (n + m2) AS p2 FROM domains JOIN s USING (suffix), m2),
ab AS (SELECT host, good + m3 * p2 AS a, n - good + m3 * (1 - p2) AS b FROM hosts JOIN d USING (domain), m3),
bounds AS (SELECT host, least(1.0, a / (a + b) + {BOUND_Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))::DOUBLE AS bound FROM ab),
rules(verdict, rhost, rpath) AS (VALUES {_RULES}),
fits AS (SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM urls) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN bound >= {MIN_GOOD} THEN 'allow' ELSE 'block' END) AS verdict, round(bound, 6) AS bound
FROM sites u JOIN bounds b ON u.site = b.host LEFT JOIN fits f ON u.page_id IS NOT DISTINCT FROM f.page_id AND u.host = f.host AND u.path = f.path""",
}
