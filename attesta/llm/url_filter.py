"""URL filtering by rules and by host reputation (empirical Bayes, beta-binomial), in DataFrame operations only.

A host's rate of bad pages is shrunk towards that of its registered domain, which is shrunk towards that of its suffix,
which is shrunk towards the rate of all labelled pages. How strongly is fitted by moments at each level: the spread of
the units' rates beyond what binomial chance explains gives the concentration of the beta prior. A host is blocked if
the lower bound of its posterior bad rate exceeds `max_bad`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "org.au", "org.uk")

Rule = tuple[str, str, str]  # host, path, verdict


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first `://`; both empty if there is none or the url is null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def domain_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a port is left out; an address, or a host of one label, is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"\.$", "")
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    number = name.rlike(r"^[0-9.]+$") | name.startswith("[")
    long = two.isin(*TWO_LABEL_SUFFIXES) & (F.size(labels) > 2)
    suffix = F.when(number, F.lit("")).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.element_at(labels, -1))
    domain = F.when(number, name).when(long, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")).otherwise(two)
    return domain, suffix


def apply_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _concentration(units: DataFrame, least: float = 2.0, most: float = 1000.0) -> float:
    """The moment estimate of a level's prior concentration from (bad, n) of its units; no spread or no labels: `most`."""
    x = units.filter("n > 0").agg(F.sum("bad").alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q")).first()
    if not x["n"] or x["n"] <= x["k"] or not 0 < x["b"] < x["n"]:
        return most
    m = x["b"] / x["n"]
    spread = x["q"] / x["n"] - m * m
    chance = m * (1 - m)
    rho = (spread / chance - x["k"] / x["n"]) / (1 - x["k"] / x["n"])
    return min(most, max(least, 1 / rho - 1)) if rho > 0 else most


def host_reputation(pages: DataFrame, *, z: float = 1.645) -> DataFrame:
    """Per host of pages (host, bad int or null where unlabelled): its posterior mean and lower bound of the bad rate."""
    domain, suffix = domain_of(F.col("host"))
    hosts = pages.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n")).withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = suffixes.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    rate = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    s, d, h = (_concentration(x) for x in (suffixes, domains, hosts))
    of_suffix = suffixes.select("suffix", ((F.lit(s * rate) + F.col("bad")) / (F.lit(s) + F.col("n"))).alias("suffix_rate"))
    of_domain = domains.join(of_suffix, "suffix").select("domain", "suffix", ((F.lit(d) * F.col("suffix_rate") + F.col("bad")) / (F.lit(d) + F.col("n"))).alias("domain_rate"))
    weight = F.lit(h) + F.col("n")
    of_host = hosts.join(of_domain, ["domain", "suffix"]).withColumn("mean", (F.lit(h) * F.col("domain_rate") + F.col("bad")) / weight)
    bound = F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (weight + 1))
    return of_host.select("host", "bad", "n", "mean", bound.alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], *, page_col: str = "page_id", url_col: str = "url", max_bad: float = 0.25, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_bound) of each page.

    outcomes: (page_id, bad 0/1) of the labelled pages; pages without one, or with a null, count for no host. Null or
    odd urls have an empty host, whose reputation is shared by all such pages. Repeated rows are each judged; repeated
    outcomes of a page count by their largest. Other columns are ignored. An empty table gives no rows; without any
    outcome the rate is one half before shrinking, and the bound then decides as it does for all.
    """
    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{page_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    seen = outcomes.groupBy(outcomes[0].alias("page_id")).agg(F.max(outcomes[1]).cast("int").alias("bad"))
    hosts = host_reputation(rows.join(seen, "page_id", "left"), z=z)
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    judged = rows.join(hosts.select("host", "mean", "bound"), "host", "left")
    own = F.when(F.col("bound") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("mean").alias("bad_rate"), F.col("bound").alias("bad_bound"))


# Fixed values of the query.
RULES: list[Rule] = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def document_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page shows the document whose number ends its path; it is bad if that document's quality is 0."""
    _, path = split_url(F.col("url"))
    shows = pages.select("page_id", F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1).alias("number"))
    shows = shows.filter("number <> ''").select("page_id", F.col("number").cast("long").alias("doc_id"))
    bad = labels.filter("quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    return shows.join(bad, "doc_id").select("page_id", "bad")


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT r.page_id, max(bad) AS bad FROM r JOIN l ON try_cast(nullif(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1), '') AS BIGINT) = l.doc_id GROUP BY r.page_id),
h0 AS (SELECT host, coalesce(sum(bad), 0) AS bad, count(bad) AS n, string_split(regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '\.$', ''), '.') AS w,
         regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '\.$', '') AS name FROM r LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT *, array_to_string(w[greatest(len(w) - 1, 1):], '.') AS two, regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') AS num FROM h0),
h AS (SELECT host, bad, n,
         CASE WHEN num THEN name WHEN two IN ({two}) AND len(w) > 2 THEN array_to_string(w[greatest(len(w) - 2, 1):], '.') ELSE two END AS domain,
         CASE WHEN num THEN '' WHEN two IN ({two}) THEN two ELSE w[-1] END AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM d GROUP BY suffix),
m AS (
  SELECT level, sum(bad)::DOUBLE AS b, sum(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(bad * bad / n::DOUBLE) AS q
  FROM (SELECT 'h' AS level, bad, n FROM h UNION ALL SELECT 'd', bad, n FROM d UNION ALL SELECT 's', bad, n FROM s) WHERE n > 0 GROUP BY level),
m2 AS (SELECT *, ((q / n - (b / n) * (b / n)) / ((b / n) * (1 - b / n)) - k / n) / (1 - k / n) AS rho FROM m WHERE n > k AND b > 0 AND b < n),
c AS (SELECT level, CASE WHEN rho > 0 THEN least(1000.0, greatest(2.0, 1 / rho - 1)) ELSE 1000.0 END AS conc FROM m2),
g AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS rate,
        coalesce((SELECT conc FROM c WHERE level = 's'), 1000.0) AS cs, coalesce((SELECT conc FROM c WHERE level = 'd'), 1000.0) AS cd,
        coalesce((SELECT conc FROM c WHERE level = 'h'), 1000.0) AS ch FROM s),
ps AS (SELECT suffix, (cs * rate + bad) / (cs + n) AS rate FROM s, g),
pd AS (SELECT domain, d.suffix, (cd * ps.rate + bad) / (cd + n) AS rate FROM d JOIN ps USING (suffix), g),
ph AS (SELECT host, (ch * pd.rate + bad) / (ch + n) AS mean, ch + n AS weight FROM h JOIN pd USING (domain, suffix), g),
v AS (SELECT host, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.25 THEN 'block' ELSE 'allow' END AS own FROM ph),
f AS (
  SELECT page_id, host, path, own, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM r JOIN v USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN own WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' ELSE 'block' END AS verdict FROM f
""".replace("{two}", ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES))
