"""URL filter by empirical-Bayes host reputation.

The share of bad pages of a host is shrunk through beta-binomial priors: suffix towards all pages, registered domain
towards its suffix, host towards its domain. How strongly is fitted at each level from the over-dispersion of the
counts (method of moments). A page is blocked when even the lower posterior bound of its host's bad share exceeds the
share of all labelled pages (or a limit that the caller gives): its host is credibly worse than the common page.
Hand-written rules come before the reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Suffixes of two labels under which names are registered; fixed values, an example set that callers may replace.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn")
#: Normal quantile of the one-sided 95 % bound.
Z = 1.6448536269514722
#: Bounds of the over-dispersion, so that priors weigh between about 0.01 and 1000 pages.
DISPERSION = (0.001, 0.99)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? # or the end, A-Z lower-cased) and path (up to ? # or the end)."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. Rules are few: they become one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(rules[rule]).alias("verdict"))).otherwise(out)
    return out


def with_domains(hosts: DataFrame, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Adds domain and suffix to a table with a host column; numeric addresses and names of one label are domains of
    their own without a suffix; no host at all has a suffix of its own, so that it has the prior of all pages."""
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":\d*$", "")
    labels = F.filter(F.split(F.col("_name"), r"\."), lambda x: x != "")
    width = F.when(F.array_join(F.slice("_labels", -2, 2), ".").isin(*suffixes) & (F.size("_labels") > 2), 2).otherwise(1)
    tail = lambda n: F.array_join(F.slice("_labels", -F.least(n, F.size("_labels")), F.least(n, F.size("_labels"))), ".")
    numeric = F.col("_name").rlike(r"^[0-9.]+$|^\[")
    out = hosts.withColumn("_name", name).withColumn("_labels", labels)
    out = out.withColumn("_alone", numeric | (F.size("_labels") < 2)).withColumn("_labels", F.when(F.size("_labels") < 2, F.array(F.lit(""), F.lit(""))).otherwise(F.col("_labels")))
    out = out.withColumn("_width", width)
    suffix = F.when(F.col("_name") == "", F.lit("?")).when(F.col("_alone"), F.lit("")).otherwise(tail(F.col("_width")))
    return out.select(*hosts.columns, F.when(F.col("_alone"), F.col("_name")).otherwise(tail(F.col("_width") + 1)).alias("domain"), suffix.alias("suffix"))


def _prior_weight(groups: DataFrame, mean: str):
    """The prior weight (pages) at a level, one number, from counts k of n and the parents' means."""
    m = F.least(F.greatest(F.col(mean), F.lit(1e-6)), F.lit(1 - 1e-6))
    share = F.col("k") / F.col("n")
    seen = groups.filter("n > 0").agg(F.sum(F.col("n") * (share - m) * (share - m) / (m * (1 - m))).alias("s"), F.count("*").alias("g"), F.sum("n").alias("n"))
    rho = F.when(F.col("n") > F.col("g"), (F.col("s") - F.col("g")) / (F.col("n") - F.col("g"))).otherwise(F.lit(DISPERSION[0]))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(DISPERSION[0])), F.lit(DISPERSION[0])), F.lit(DISPERSION[1]))
    return F.lit(seen.select((1 - rho) / rho).first()[0])


def host_reputation(outcomes: DataFrame, hosts: DataFrame, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, k, mean, bound, common) of every host of ``hosts``, from ``outcomes`` (host, bad 0/1, one row a page);
    common is the bad share of all pages.

    Hosts without outcomes have their domain's prior; without any outcome at all the mean is one half. Sums are made
    before anything is joined, so a host with most pages is one row.
    """
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("k"))
    level = staged(with_domains(hosts.select("host").distinct().join(counts, "host", "left").fillna(0, ["n", "k"]), suffixes), "host-counts")
    total = level.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2))).first()[0]
    suffix = level.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m0", F.lit(total))
    suffix = suffix.withColumn("weight", _prior_weight(suffix, "m0")).select("suffix", ((F.col("weight") * F.col("m0") + F.col("k")) / (F.col("weight") + F.col("n"))).alias("m1"))
    domain = level.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffix, "suffix")
    domain = domain.withColumn("weight", _prior_weight(domain, "m1")).select("suffix", "domain", ((F.col("weight") * F.col("m1") + F.col("k")) / (F.col("weight") + F.col("n"))).alias("m2"))
    host = level.join(domain, ["suffix", "domain"])
    host = host.withColumn("weight", _prior_weight(host, "m2"))
    a, b = F.col("weight") * F.col("m2") + F.col("k"), F.col("weight") * (1 - F.col("m2")) + F.col("n") - F.col("k")
    mean = a / (a + b)
    return host.select("host", "n", "k", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"), F.lit(total).alias("common"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page's outcome is the label of the document that the last number in its path names; bad is
    quality 0 or toxic 1. Pages without a labelled document have none; repeated labels count as their worst."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    worst = labels.groupBy("doc_id").agg(F.max(bad).alias("bad")).filter("bad IS NOT NULL AND doc_id IS NOT NULL")
    number = F.expr(r"try_cast(nullif(regexp_extract(path, '/([0-9]+)(\\.[a-z]+)?/?$', 1), '') AS bigint)")
    return pages.select("host", number.alias("doc_id")).join(worst, "doc_id").select("host", "bad")


def judge_urls(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules: dict[str, str] = RULES, limit: float | None = None, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(key, host, path, rule, verdict, bound) of every row of ``pages``; without a ``limit`` the bound is held against
    the bad share of all labelled pages.

    A null url, or one without ://, has an empty host and path, fits no rule and is judged by the prior of all pages,
    whose bound lies below their share: it is allowed. Repeated rows are judged alike and count as often as they occur;
    extra columns are not read.
    """
    host, path = url_parts(F.col(url))
    parsed = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    reputation = host_reputation(page_outcomes(parsed, labels), parsed, suffixes)
    judged = parsed.join(reputation.select("host", "bound", "common"), "host", "left").withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bound") > (F.col("common") if limit is None else F.lit(float(limit))), "block").otherwise("allow"))
    return judged.select(key, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "bound")


def decisions(judged: DataFrame) -> DataFrame:
    """(by, verdict, pages): how many pages rules and reputation decided, and how."""
    return judged.groupBy(F.when(F.col("rule").isNull(), "reputation").otherwise("rule").alias("by"), "verdict").agg(F.count("*").alias("pages"))


def op1_host_reputation(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, table(spark, sf_dir, "labels")).drop("bound")


_WEIGHT = """SELECT (1 - rho) / rho AS weight FROM (SELECT least(greatest(coalesce(CASE WHEN sum(n) > count(*) THEN
    (sum(n * (k / n - m) * (k / n - m) / (m * (1 - m))) - count(*)) / (sum(n) - count(*)) ELSE 0.001 END, 0.001), 0.001::DOUBLE), 0.99::DOUBLE) AS rho
    FROM (SELECT n::DOUBLE AS n, k::DOUBLE AS k, least(greatest({m}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS m FROM {t} WHERE n > 0))"""
OP1_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), worst AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id
), numbered AS (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]+)(\.[a-z]+)?/?$', 1), '') AS BIGINT) AS doc_id FROM p),
counts AS (SELECT host, count(bad) AS n, sum(bad) AS k FROM numbered JOIN worst USING (doc_id) WHERE bad IS NOT NULL GROUP BY host),
named AS (
  SELECT h.host, coalesce(n, 0)::DOUBLE AS n, coalesce(k, 0)::DOUBLE AS k, regexp_replace(regexp_replace(h.host, '^.*@', ''), ':\d*$', '') AS name
  FROM (SELECT DISTINCT host FROM p) h LEFT JOIN counts c ON h.host = c.host
), labelled AS (SELECT *, list_filter(string_split(name, '.'), lambda x: x <> '') AS l0, regexp_matches(name, '^[0-9.]+$|^\[') AS num FROM named),
padded AS (SELECT *, CASE WHEN len(l0) < 2 THEN ['', ''] ELSE l0 END AS l, num OR len(l0) < 2 AS alone FROM labelled),
widths AS (
  SELECT *, CASE WHEN len(l) > 2 AND array_to_string(l[-2:], '.') IN ({", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)}) THEN 2 ELSE 1 END AS w FROM padded
), level AS (
  SELECT host, n, k, CASE WHEN alone THEN name ELSE array_to_string(l[len(l) - least(w + 1, len(l)) + 1 :], '.') END AS domain,
    CASE WHEN name = '' THEN '?' WHEN alone THEN '' ELSE array_to_string(l[len(l) - least(w, len(l)) + 1 :], '.') END AS suffix FROM widths
), total AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS m0 FROM level),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m0) AS m0 FROM level, total GROUP BY suffix),
sw AS ({_WEIGHT.format(m="m0", t="s0")}),
s1 AS (SELECT suffix, (weight * m0 + k) / (weight + n) AS m1 FROM s0, sw),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k, any_value(m1) AS m1 FROM level JOIN s1 USING (suffix) GROUP BY ALL),
dw AS ({_WEIGHT.format(m="m1", t="d0")}),
d1 AS (SELECT suffix, domain, (weight * m1 + k) / (weight + n) AS m2 FROM d0, dw),
h0 AS (SELECT host, n, k, m2 FROM level JOIN d1 USING (suffix, domain)),
hw AS ({_WEIGHT.format(m="m2", t="h0")}),
post AS (SELECT host, weight * m2 + k AS a, weight * (1 - m2) + n - k AS b FROM h0, hw),
bounds AS (SELECT host, a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM post),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r in sorted(RULES, key=lambda r: (-len(r), r)))} END AS rule FROM p
)
SELECT page_id, ruled.host, path, rule, CASE rule {" ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())} ELSE CASE WHEN bound > (SELECT m0 FROM total) THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled JOIN bounds ON ruled.host = bounds.host
"""
