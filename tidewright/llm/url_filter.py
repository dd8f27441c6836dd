"""URL filter: explicit rules first, then empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (bad or not) are counted per host. Each level's rate is shrunk towards the one above it by a
beta-binomial prior: host to registered domain to suffix to all. The prior's strength on a level comes from the spread
of its groups around their parents' means by the method of moments: with rho = 1 / (strength + 1),
    sum n (p - mu)^2 = sum mu (1 - mu) (1 + (n - 1) rho),
solved for rho and held within [rho_min, rho_max]. A host is blocked when the lower bound of its posterior bad rate,
mean - z * sd of Beta(a, b), reaches `threshold`.

Counts go through partial aggregation, so one host with a third of all rows is one row per task; reputations are made
for each distinct host, and meet the pages in one join that splits hosts of many pages by their counts.

Defined results: a null url, or one without "://", has empty host and path, fits no rule and is judged like a host
without labels; repeated page_ids give a row each; null outcomes are no labels; without any label nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import spread_join, stage, table

#: (verdict, host, path); the longest that fits wins, on a tie the longer host, then block.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Suffixes of two labels under which domains are registered; others have one label. A parameter of reputation().
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "co.za", "com.mx", "com.tr")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does. One CASE: meant for up to some hundred rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    best = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block", r))
    for says, h, p in best:  # the last wrapped is tried first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column, two=TWO_LABEL_SUFFIXES) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*two), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two=TWO_LABEL_SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*two), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(groups: DataFrame, rho_min: float, rho_max: float) -> float:
    """The strength of the prior, from groups with n, bad and the parent's mean mu."""
    n, v = F.col("n"), F.col("mu") * (1 - F.col("mu"))
    over, room = groups.agg(F.sum(n * F.pow(F.col("bad") / n - F.col("mu"), 2) - v), F.sum(v * (n - 1))).first()
    rho = over / room if room else rho_max
    return 1 / min(max(rho, rho_min), rho_max) - 1


def reputation(hosts: DataFrame, outcomes: DataFrame, two=TWO_LABEL_SUFFIXES, rho_min: float = 0.001, rho_max: float = 0.5) -> DataFrame:
    """(host, n, mean, bound inputs a and b) for every host in hosts (host) given outcomes (host, bad 0/1)."""
    of_host = outcomes.filter("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    # a row per labelled host: counted once, written, and summed up from there
    of_host = stage(of_host.withColumns({"domain": domain_of(F.col("host"), two), "suffix": suffix_of(F.col("host"), two)}), "hosts")
    of_domain = stage(of_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    of_suffix = stage(of_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    # the overall mean and a strength per level are single numbers, which come to the driver
    mean0 = of_suffix.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).first()[0]

    def shrunk(groups: DataFrame, name: str) -> DataFrame:
        s = F.lit(_strength(groups, rho_min, rho_max))
        return stage(groups.withColumn("mean", (F.col("bad") + s * F.col("mu")) / (F.col("n") + s)), name)

    suffixes = shrunk(of_suffix.withColumn("mu", F.lit(mean0)), "suffix-means").select("suffix", F.col("mean").alias("suffix_mean"))
    domains = shrunk(of_domain.join(suffixes, "suffix").withColumnRenamed("suffix_mean", "mu"), "domain-means").select("domain", F.col("mean").alias("domain_mean"))
    s3 = F.lit(_strength(of_host.join(domains, "domain").withColumnRenamed("domain_mean", "mu"), rho_min, rho_max))
    every = hosts.select("host").distinct().withColumns({"domain": domain_of(F.col("host"), two), "suffix": suffix_of(F.col("host"), two)})
    prior = F.coalesce("domain_mean", "suffix_mean", F.lit(mean0))
    rated = (
        every.join(domains, "domain", "left").join(suffixes, "suffix", "left")
        .join(of_host.select("host", "n", "bad"), "host", "left")
    )
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    return rated.select("host", n.alias("n"), (bad + s3 * prior).alias("a"), (n - bad + s3 * (1 - prior)).alias("b"))


def lower_bound(a: Column, b: Column, z: float) -> Column:
    mean = a / (a + b)
    return mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judge(
    pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, two=TWO_LABEL_SUFFIXES,
    threshold: float = 0.5, z: float = 1.645,
) -> DataFrame:
    """(id, host, path, rule, verdict, bad_bound) for every row of pages; outcomes: (host, bad)."""
    url = F.col(url_col).cast("string")
    cut = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = stage(cut.groupBy("host").agg(F.count("*").alias("pages")), "page-hosts")
    n_pages = hosts.agg(F.sum("pages")).first()[0] or 0
    rated = reputation(hosts, outcomes, two).select("host", F.round(lower_bound(F.col("a"), F.col("b"), z), 9).alias("bad_bound"))
    rated = stage(rated.join(hosts, "host"), "rated-hosts")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") >= threshold, "block").otherwise("allow")
    return spread_join(cut, rated, "host", "pages", n_pages).select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_bound")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of labelled pages: a page's path ends in the number of the document it shows, which labels may rate.

    bad: quality 0 or toxic 1; null where the label leaves that open.
    """
    url = F.col("url").cast("string")
    shown = pages.select(host_of(url).alias("host"), F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*[^?#]*/([0-9]+)(?:[?#]|$)', 1) as bigint)").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    rated = labels.select("doc_id", bad.alias("bad")).groupBy("doc_id").agg(F.max("bad").alias("bad"))
    return shown.filter("doc_id is not null").join(rated, "doc_id").select("host", "bad")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages under RULES, and the reputation that labels give its host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))
    return found.withColumnRenamed("id", "page_id").drop("bad_bound")


def _sql(threshold: float = 0.5, z: float = 1.645) -> str:
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    fits = [(v, h, p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for _, h, p, f in fits)
    says = " ".join(f"WHEN {f} THEN '{v}'" for v, _, _, f in fits)
    strength = "SELECT 1 / least(greatest(CASE WHEN sum(mu * (1 - mu) * (n - 1)) > 0 THEN sum(n * (bad / n - mu) ** 2 - mu * (1 - mu)) / sum(mu * (1 - mu) * (n - 1)) ELSE 0.5 END, 0.001), 0.5) - 1 AS s"
    return rf"""
WITH cut AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    TRY_CAST(regexp_extract(url, '://[^/?#]*[^?#]*/([0-9]+)(?:[?#]|$)', 1) AS BIGINT) AS doc_id FROM pages),
named AS (SELECT DISTINCT host, list_reverse(string_split(host, '.')) AS l FROM cut),
parts AS (SELECT host, CASE WHEN host IN ({two}) OR (len(l) > 1 AND l[2] || '.' || l[1] IN ({two})) THEN l[2] || '.' || l[1] ELSE l[1] END AS suffix,
    CASE WHEN len(l) > 2 AND l[2] || '.' || l[1] IN ({two}) THEN l[3] || '.' || l[2] || '.' || l[1] WHEN len(l) > 1 THEN l[2] || '.' || l[1] ELSE l[1] END AS domain FROM named),
rated AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 0 END) AS bad FROM labels GROUP BY doc_id),
of_host AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM cut JOIN rated USING (doc_id) JOIN parts USING (host) WHERE bad IS NOT NULL GROUP BY ALL),
of_domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM of_host GROUP BY ALL),
of_suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM of_host) AS mu FROM of_domain GROUP BY suffix),
whole AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean0 FROM of_host),
suffixes AS (SELECT suffix, (bad + s * mu) / (n + s) AS suffix_mean FROM of_suffix, ({strength} FROM of_suffix)),
dm AS (SELECT domain, n, bad, suffix_mean AS mu FROM of_domain JOIN suffixes USING (suffix)),
domains AS (SELECT domain, (bad + s * mu) / (n + s) AS domain_mean FROM dm, ({strength} FROM dm)),
hm AS (SELECT host, n, bad, domain_mean AS mu FROM of_host JOIN domains USING (domain)),
ab AS (SELECT p.host, coalesce(h.bad, 0) + s * coalesce(domain_mean, suffix_mean, mean0) AS a,
    coalesce(h.n, 0) - coalesce(h.bad, 0) + s * (1 - coalesce(domain_mean, suffix_mean, mean0)) AS b
    FROM parts p LEFT JOIN domains USING (domain) LEFT JOIN suffixes USING (suffix) LEFT JOIN of_host h ON h.host = p.host, whole, ({strength} FROM hm)),
bound AS (SELECT host, round(a / (a + b) - {z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 9) AS bad_bound FROM ab)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {says} END, CASE WHEN bad_bound >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM cut JOIN bound USING (host)
"""


SQL = _sql()
