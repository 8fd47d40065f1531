"""URL filters: fixed rules, and the reputation of hosts by empirical Bayes, in DataFrame operations only.

Labelled pages of a host are binomial draws of its rate of bad pages. The rate's prior is a beta distribution whose mean
is the posterior mean of the host's registered domain, whose own prior has the mean of its suffix, and that of all pages.
How strong the priors of a level are is estimated from how much the groups of that level differ (method of moments). A
host is blocked once the lower bound of its posterior exceeds a limit, so a host with few labels is judged by its domain
and suffix, and one with many by its own pages.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_filter, maybe_in, skew_lookup, stored

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels below which names are registered; any other suffix is the last label.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "net.au", "or.jp", "org.au", "org.uk")
MAX_BAD, CONFIDENCE = 0.25, 0.95
STRENGTH = (0.5, 10_000.0)  # least and greatest number of pages that a prior counts for
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/``, ``?`` or ``#`` with A-Z lower-cased, and then up to ``?`` or ``#``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, null if none does; of equally long ones the longer host wins."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def site_of(host: Column, suffixes: tuple = SUFFIXES) -> tuple[Column, Column, Column]:
    """(site, domain, suffix) of a host: the host less user, port and closing dots; an address of digits is its own domain and suffix."""
    site = F.regexp_replace(host, r"^[^@]*@|:[0-9]*$|\.+$|\.+(?=:[0-9]*$)", "")
    two = F.substring_index(site, ".", -2)
    long_ = two.isin(*suffixes)
    whole = site.rlike(r"^[0-9.]*$|[\[:]")
    suffix = F.when(whole, site).when(long_, two).otherwise(F.substring_index(site, ".", -1))
    domain = F.when(whole, site).when(long_, F.substring_index(site, ".", -3)).otherwise(two)
    return site, domain, suffix


def _polygamma(x: str) -> tuple[str, str, str]:
    """SQL: the first three derivatives of the logarithm of the gamma function: a series at x + 6, and the recurrence down to x."""
    y = f"({x} + 6)"
    down = lambda term: f"aggregate(sequence(0, 5), 0D, (s_, i_) -> s_ + {term})"
    return (
        f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * power({y}, 2)) + 1 / (120 * power({y}, 4)) - 1 / (252 * power({y}, 6)) - {down(f'1 / ({x} + i_)')})",
        f"(1 / {y} + 1 / (2 * power({y}, 2)) + 1 / (6 * power({y}, 3)) - 1 / (30 * power({y}, 5)) + 1 / (42 * power({y}, 7)) + {down(f'power({x} + i_, -2)')})",
        f"(- 1 / power({y}, 2) - 1 / power({y}, 3) - 1 / (2 * power({y}, 4)) + 1 / (6 * power({y}, 6)) - 1 / (6 * power({y}, 8)) - {down(f'2 * power({x} + i_, -3)')})",
    )


def lower_bound(a: str, b: str, confidence: float) -> Column:
    """The value that a beta(a, b) variable exceeds with that confidence: the quantile of its logit by mean, variance and skewness (Cornish-Fisher)."""
    z = NormalDist().inv_cdf(1 - confidence)
    (a0, a1, a2), (b0, b1, b2) = _polygamma(a), _polygamma(b)
    var = f"({a1} + {b1})"
    logit = f"{a0} - {b0} + sqrt({var}) * ({z!r}D) + ({(z * z - 1) / 6!r}D) * ({a2} - {b2}) / {var}"
    return F.expr(f"1 / (1 + exp(-({logit})))")


def _strength(groups: DataFrame) -> float:
    """How many pages the prior of groups (n, k, mean) counts for.

    k has the variance n p q (1 + (n - 1) r) about n p, and r = 1 / (strength + 1). Nothing that differs more than by
    chance gives the greatest strength.
    """
    pq = F.col("mean") * (1 - F.col("mean"))
    sums = groups.agg(F.sum((F.col("k") - F.col("n") * F.col("mean")) ** 2 - F.col("n") * pq).alias("over"), F.sum(F.col("n") * (F.col("n") - 1) * pq).alias("pairs")).first()
    if not sums["pairs"]:
        return STRENGTH[1]
    r = sums["over"] / sums["pairs"]
    return min(max(1 / r - 1, STRENGTH[0]), STRENGTH[1]) if r > 0 else STRENGTH[1]


def _below(groups: DataFrame, above: DataFrame | None, key: str, mean: float, total: int) -> DataFrame:
    """groups (n, k, pages, ...) with their prior's mean: the posterior mean of their group ``key`` above, or one for all."""
    if above is None:
        return groups.withColumn("mean", F.lit(mean))
    size = groups.groupBy(key).agg(F.count("*").alias("members"))
    return skew_lookup(groups, above.join(size, key), key, "members", total).drop("members")


def reputations(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", confidence: float = CONFIDENCE, suffixes: tuple = SUFFIXES) -> DataFrame:
    """(site, pages, n_labelled, n_bad, prior_mean, alpha, beta, bound) for each site of pages.

    outcomes are (id, bad boolean); an id that repeats is bad if it ever is, and null ids or outcomes don't count. Pages
    that repeat an id each count. Without a labelled page the mean is one half. Pages without a host are one site, the
    empty one. An empty table gives none.
    """
    site, domain, suffix = site_of(split_url(F.col(url_col))[0], suffixes)
    named = pages.select(F.col(id_col).cast("long").alias("id"), site.alias("site"))
    known = outcomes.select(F.col(outcomes.columns[0]).cast("long").alias("id"), F.col(outcomes.columns[1]).cast("boolean").alias("bad")).dropna().groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    known = stored(known, "outcomes")
    filter_pages, slot = id_filter(known.select("id"), known.count())
    # A row for each id and site: an id that very many pages of a site repeat is one row with a count.
    hits = maybe_in(named.filter("id is not null"), F.col("id"), filter_pages, slot).groupBy("id", "site").agg(F.count("*").alias("m")).join(known, "id")
    counted = hits.groupBy("site").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("bad")).alias("k"))
    sites = named.groupBy("site").agg(F.count("*").alias("pages")).join(counted, "site", "left").fillna(0, ["n", "k"])
    _, domain, suffix = site_of(F.col("site"), suffixes)
    sites = stored(sites.withColumns({"domain": domain, "suffix": suffix}), "sites")
    sums = sites.agg(F.sum("n"), F.sum("k"), F.count("*")).first()
    mean = sums[1] / sums[0] if sums[0] else 0.5
    above, held = None, []
    for level, key in (("suffix", ""), ("domain", "suffix"), ("site", "domain")):
        groups = sites if level == "site" else sites.groupBy(level).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), *([F.first("suffix").alias("suffix")] if level == "domain" else []))
        groups = stored(_below(groups, above, key, mean, sums[2] or 0), "reputation")
        held.append(groups)
        m = F.lit(_strength(groups))
        groups = groups.withColumns({"alpha": m * F.col("mean") + F.col("k"), "beta": m * (1 - F.col("mean")) + F.col("n") - F.col("k")})
        above = groups.select(level, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean"))
    bound = F.when(F.col("mean") <= 0, 0.0).when(F.col("mean") >= 1, 1.0).otherwise(lower_bound("alpha", "beta", confidence))
    out = stored(groups.select("site", "pages", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), F.col("mean").alias("prior_mean"), "alpha", "beta", bound.alias("bound")), "reputations")
    discard(known, sites, *held)
    return out


def url_filter(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, max_bad: float = MAX_BAD, confidence: float = CONFIDENCE, suffixes: tuple = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, n_bad, bound) for each row of pages.

    The verdict is that of the longest rule that fits, else block if the bound of the host's reputation exceeds max_bad,
    else allow. A null url, or one without ``://``, has an empty host and path. Null and repeated ids pass through; other
    columns are ignored. An empty table gives an empty result.
    """
    host, path = split_url(F.col(url_col))
    split = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), verdict.alias("verdict"), site_of(F.col("host"), suffixes)[0].alias("site"))
    known = reputations(pages, outcomes, id_col=id_col, url_col=url_col, confidence=confidence, suffixes=suffixes)
    index = known.select("site", "pages", "n_labelled", "n_bad", "bound")
    total = index.agg(F.sum("pages")).first()[0] or 0
    judged = skew_lookup(ruled, index, "site", "pages", total)
    method = F.when(F.col("bound") > max_bad, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "n_labelled", "n_bad", "bound")


ORACLE = r"""
with recursive url as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from url),
sited as (select *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '\.+$', '') as site from split),
labelled as (select doc_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels where doc_id is not null and (toxic is not null or quality is not null) group by doc_id),
sites as (select site, count(bad) as n, coalesce(sum(bad), 0)::bigint as k from sited left join labelled on page_id = doc_id group by site),
cut as (select *, string_split(site, '.') as l, list_contains(['ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'net.au', 'or.jp', 'org.au', 'org.uk'], array_to_string(string_split(site, '.')[-2:], '.')) as two, regexp_matches(site, '^[0-9.]*$|[\[:]') as whole from sites),
hosts as (select site, n, k, case when whole then site else array_to_string(l[(case when two then -3 else -2 end):], '.') end as domain, case when whole then site when two then array_to_string(l[-2:], '.') else l[-1] end as suffix from cut),
s0 as (select suffix, sum(n) as n, sum(k) as k, (select coalesce(sum(k) / nullif(sum(n), 0), 0.5) from hosts) as mean from hosts group by suffix),
ms as (select sum(power(k - n * mean, 2) - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0) as r from s0),
s1 as (select suffix, (m * mean + k) / (m + n) as mean from s0, (select case when r > 0 then least(greatest(1 / r - 1, 0.5), 10000.0) else 10000.0 end as m from ms)),
d0 as (select domain, any_value(suffix) as suffix, sum(n) as n, sum(k) as k from hosts group by domain),
d1 as (select d0.*, s1.mean from d0 join s1 using (suffix)),
md as (select sum(power(k - n * mean, 2) - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0) as r from d1),
d2 as (select domain, (m * mean + k) / (m + n) as mean from d1, (select case when r > 0 then least(greatest(1 / r - 1, 0.5), 10000.0) else 10000.0 end as m from md)),
h0 as (select hosts.*, d2.mean from hosts join d2 using (domain)),
mh as (select sum(power(k - n * mean, 2) - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0) as r from h0),
h1 as (select site, n, k, mean, m * mean + k as a, m * (1 - mean) + n - k as b from h0, (select case when r > 0 then least(greatest(1 / r - 1, 0.5), 10000.0) else 10000.0 end as m from mh)),
x as (select site, n, k, mean, unnest([a, b]) as v, unnest([1, -1]) as sign from h1),
g as (select site, n, k, mean, sign * (ln(v + 6) - 1 / (2 * (v + 6)) - 1 / (12 * power(v + 6, 2)) + 1 / (120 * power(v + 6, 4)) - 1 / (252 * power(v + 6, 6)) - (1 / v + 1 / (v + 1) + 1 / (v + 2) + 1 / (v + 3) + 1 / (v + 4) + 1 / (v + 5))) as psi,
  1 / (v + 6) + 1 / (2 * power(v + 6, 2)) + 1 / (6 * power(v + 6, 3)) - 1 / (30 * power(v + 6, 5)) + 1 / (42 * power(v + 6, 7)) + (power(v, -2) + power(v + 1, -2) + power(v + 2, -2) + power(v + 3, -2) + power(v + 4, -2) + power(v + 5, -2)) as psi1,
  sign * (-power(v + 6, -2) - power(v + 6, -3) - power(v + 6, -4) / 2 + power(v + 6, -6) / 6 - power(v + 6, -8) / 6 - 2 * (power(v, -3) + power(v + 1, -3) + power(v + 2, -3) + power(v + 3, -3) + power(v + 4, -3) + power(v + 5, -3))) as psi2 from x where v > 0),
bounds as (select site, any_value(n)::bigint as n_labelled, any_value(k)::bigint as n_bad, case when any_value(mean) <= 0 then 0.0 when any_value(mean) >= 1 then 1.0 else 1 / (1 + exp(1.6448536269514722 * sqrt(sum(psi1)) - sum(psi) - (power(1.6448536269514722, 2) - 1) / 6 * sum(psi2) / sum(psi1))) end as bound from g group by site)
select page_id, host, path,
  case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
       when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
       when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
       when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null or bound > 0.25 then 'block' else 'allow' end as verdict,
  n_labelled, n_bad, round(bound, 4) as bad_bound
from sited join bounds using (site)
"""
