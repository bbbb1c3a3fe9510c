"""URL filter: rule lists first, then empirical-Bayes host reputation (DataFrame functions only).

A page's outcome is a weak label of its own: it is good if its article (the whole page where there
is none) holds ``THIN`` visible words or more.  Outcomes are counted by host, registered domain and
suffix.  Each level has a beta-binomial prior: its mean is the posterior mean one level up (the
corpus rate at the top), its strength is estimated by moments from the spread between the groups of
the level.  A page that no rule fits is blocked when the upper posterior bound of its host's good
rate (mean + ``z`` standard deviations) is below the corpus rate: when the host is surely worse than
the corpus.  Hosts with few pages are drawn to their domain, and so are not blocked for a bad page
or two.

Suffixes are the last label, or the last two under the second-level labels of ``SECOND``; private
suffixes (blog hosters and such) are not known, so their hosts share a domain.

Hosts join back by a shuffle join on counts of one row a host; a hot host is pre-aggregated
on one side and split by adaptive skew handling on the other.

Null urls, or such without ``://``, have empty host and path, which form a host of their own.
A null page has no outcome; a page without words is a bad one.  Repeated page rows are each judged
and each counted.  With no outcomes at all nothing is blocked but by rules.  Only the columns named
are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, lower_ascii, read

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Second-level labels under which two-letter suffixes register names.
SECOND = "(?:co|com|org|net|ac|gov|edu)"
SUFFIX = rf"(?:{SECOND}\.[a-z][a-z]|[^.]+)$"
DOMAIN = rf"[^.]+\.(?:{SECOND}\.[a-z][a-z]|[^.]+)$"
Z, THIN = 1.645, 30


def split_url(url):
    """Host (A-Z lower-cased) and path of a url column, both empty where it has no ``://``."""
    u = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def fitting_rule(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def _strength(groups: DataFrame, n: str, s: str):
    """One row: corpus rate p and prior strength k by moments; groups without outcomes count for nothing."""
    g = groups.where(F.col(n) > 0)
    t = g.agg(F.sum(n).alias("N"), F.sum(s).alias("S"), F.count("*").alias("G"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("Q"))
    p = F.col("S") / F.col("N")
    spread = F.col("Q") / F.col("N") - p * p - p * (1 - p) * F.col("G") / F.col("N")
    k = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), p * (1 - p) / spread - 1))).otherwise(1000.0)
    return t.select(F.round(p, 6).alias("p"), F.round(k, 3).alias("k"))


#: What a reader doesn't see of a page; the article of a page.
UNSEEN, ARTICLE = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", r"(?is)<article.*</article>"


def outcome(html):
    """1 for a page with enough visible words, 0 for a thin one, null for none."""
    article = F.regexp_extract(html, ARTICLE, 0)
    seen = F.regexp_replace(F.when(article == "", html).otherwise(article), UNSEEN, " ")
    return (F.regexp_count(seen, F.lit(WORD)) >= THIN).cast("long")


def reputation(pages: DataFrame, z: float = Z) -> DataFrame:
    """pages(host, good 1, 0 or null) -> one row for each host: n, mean, bound, corpus (the corpus rate)."""
    zero = F.lit(0).cast("long")
    hosts = pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), zero).alias("s"))
    name = F.regexp_extract("host", DOMAIN, 0)
    hosts = hosts.select("*", F.when(name == "", F.col("host")).otherwise(name).alias("domain"), F.regexp_extract("host", SUFFIX, 0).alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("nd"), F.sum("s").alias("sd"))
    suffixes = domains.groupBy("suffix").agg(F.sum("nd").alias("nx"), F.sum("sd").alias("sx"))
    prior = lambda name, a: F.broadcast(a.withColumnsRenamed({"p": f"p{name}", "k": f"k{name}"}))  # noqa: E731  one row each
    x = suffixes.join(prior("x", _strength(suffixes, "nx", "sx")), F.lit(True))
    x = x.select("suffix", F.coalesce((F.col("sx") + F.col("kx") * F.col("px")) / (F.col("nx") + F.col("kx")), F.lit(1.0)).alias("mx"))
    d = domains.join(x, "suffix").join(prior("d", _strength(domains, "nd", "sd")).drop("pd"), F.lit(True))
    d = d.select("domain", "suffix", F.coalesce((F.col("sd") + F.col("kd") * F.col("mx")) / (F.col("nd") + F.col("kd")), F.lit(1.0)).alias("md"))
    h = hosts.join(d, ["domain", "suffix"]).join(prior("h", _strength(hosts, "n", "s")), F.lit(True))
    total = F.col("n") + F.coalesce("kh", F.lit(1.0))
    h = h.select("host", "n", F.col("ph").alias("corpus"), F.coalesce((F.col("s") + F.col("kh") * F.col("md")) / total, F.lit(1.0)).alias("mean"), total.alias("_t"))
    return h.select("host", "n", "corpus", F.round("mean", 6).alias("mean"), F.round(F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("_t") + 1)), 6).alias("bound"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    host, path = split_url(F.col("url"))
    pages = read(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), "html")
    rep = reputation(pages.select("host", outcome(F.col("html")).alias("good")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"))
    j = pages.drop("html").join(rep, "host")
    reputed = F.when(F.col("bound") < F.col("corpus"), "block").otherwise("allow")
    return j.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, reputed).alias("verdict"), F.col("n").alias("host_outcomes"), F.col("mean").alias("host_mean"), F.col("bound").alias("host_bound"))


def op2_sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + " WHEN bound < corpus THEN 'block' ELSE 'allow' END"
    def k(t, n, s):
        return f"(SELECT round(p, 6) AS p, round(CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, p * (1 - p) / v - 1)) ELSE 1000.0 END, 3) AS k FROM (SELECT p, q / nn - p * p - p * (1 - p) * g / nn AS v FROM (SELECT sum({s}) / sum({n}) AS p, sum({n}) AS nn, count(*) AS g, sum({s} * {s} / {n}) AS q FROM {t} WHERE {n} > 0)))"
    return rf"""
WITH a AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
p AS (SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path,
 (len(regexp_extract_all(regexp_replace(CASE WHEN regexp_extract(html, '{ARTICLE}') = '' THEN html ELSE regexp_extract(html, '{ARTICLE}') END, '{UNSEEN}', ' ', 'g'), '{WORD}')) >= {THIN})::BIGINT AS good FROM a),
h0 AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS s FROM p GROUP BY host),
h AS (SELECT *, CASE WHEN regexp_extract(host, '{DOMAIN}') = '' THEN host ELSE regexp_extract(host, '{DOMAIN}') END AS domain, regexp_extract(host, '{SUFFIX}') AS suffix FROM h0),
d AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM h GROUP BY ALL), x AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM d GROUP BY ALL),
mx AS (SELECT suffix, coalesce((s + k * p) / (n + k), 1.0) AS m FROM x, {k("x", "n", "s")}),
md AS (SELECT domain, suffix, coalesce((s + k * m) / (n + k), 1.0) AS m FROM d JOIN mx USING (suffix), {k("d", "n", "s")}),
mh AS (SELECT host, n, p AS corpus, coalesce((s + k * m) / (n + k), 1.0) AS m, n + coalesce(k, 1.0) AS t FROM h JOIN md USING (domain, suffix), {k("h", "n", "s")}),
r AS (SELECT host, n::BIGINT AS n, corpus, round(m, 6) AS mean, round(m + {Z} * sqrt(m * (1 - m) / (t + 1)), 6) AS bound FROM mh)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, n AS host_outcomes, mean AS host_mean, bound AS host_bound FROM p JOIN r USING (host)"""
