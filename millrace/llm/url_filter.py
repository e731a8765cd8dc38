"""URL filters: rules first, then empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, field, packed, table, unpacked

#: Fixed values of the query: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Rules stand in the expression of every row.
MAX_RULES = 1000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _label(host: Column, n: int) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.substring_index(host, ".", -n))


def _moments(groups: DataFrame, up: list[str]) -> DataFrame:
    """For the groups (bad, n) under each parent: the prior strength by the method of moments.

    With parent rate m, the groups' spread around m beyond what binomial noise explains gives the
    correlation rho, and the strength 1 / rho - 1, held between 1 and 1000.
    """
    m = F.col("_pbad") / F.col("_pn")
    sums = groups.groupBy(*up).agg(F.sum("bad").alias("_pbad"), F.sum("n").alias("_pn"), F.count("*").alias("_g"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("_sq"))
    noise = m * (1 - m)
    spread = F.col("_sq") / F.col("_pn") - m * m
    rho = F.when((noise > 0) & (F.col("_pn") > F.col("_g")), (spread - noise * F.col("_g") / F.col("_pn")) / (noise * (1 - F.col("_g") / F.col("_pn"))))
    return sums.select(*up, F.col("_pbad").alias("bad"), F.col("_pn").alias("n"), F.least(F.greatest(F.coalesce(1 / F.greatest(rho, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1.0)), F.lit(1000.0)).alias("strength"))


def host_reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors from labelled page outcomes (host string, bad 0/1): tables for host, registered domain
    (last two labels), suffix (last label) and all, each with the beta parameters `a`, `b` of the bad rate.

    Each level's prior is its parent's posterior mean with a strength fitted to the spread of the children
    (see `_moments`); all has a uniform prior. Outcomes are summed per host before anything is shuffled.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("bad").cast("double").alias("bad"), F.count("*").cast("double").alias("n"))
    hosts = hosts.withColumn("domain", _label(F.col("host"), 2)).withColumn("suffix", _label(F.col("host"), 1))
    domains = _moments(hosts, ["domain", "suffix"])
    suffixes = _moments(domains, ["suffix"])
    top = _moments(suffixes, [])
    top = top.select((F.col("bad") + 1).alias("a"), (F.col("n") - F.col("bad") + 1).alias("b"), F.col("strength").alias("k"))

    def under(child: DataFrame, parent: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
        p = parent.select(*on, (F.col("a") / (F.col("a") + F.col("b"))).alias("_m"), F.col("k").alias("_k"))
        joined = child.join(p, on) if on else child.crossJoin(F.broadcast(p))  # one row: the prior of all
        return joined.select(*keep, (F.col("_m") * F.col("_k") + F.col("bad")).alias("a"), ((1 - F.col("_m")) * F.col("_k") + F.col("n") - F.col("bad")).alias("b"), *([F.col("strength").alias("k")] if "strength" in child.columns else []))

    suffixes = under(suffixes, top, [], ["suffix"])
    domains = under(domains, suffixes, ["suffix"], ["domain", "suffix"])
    return under(hosts, domains, ["domain", "suffix"], ["host"]), domains, suffixes, top


def _bound(a: Column, b: Column, z: float) -> Column:
    """A lower bound of the bad rate: z deviations below the posterior mean."""
    n = a + b
    return a / n - F.lit(z) * F.sqrt(a * b / (n * n * (n + 1)))


def url_filter(pages: DataFrame, rules=RULES, z: float = 1.645, limit: float = 0.5, outcomes: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """Judges every url: `pages` with host, path, rule and verdict (these replace columns so named).

    The host stands between the first :// and the next /, ? or # (A-Z lower-cased), the path from there
    to ? or #. A rule (verdict, host, path) fits its host and subdomains if the path starts with its own;
    the longest fitting one decides, of equally long ones the last by verdict, host and path, and `rule` shows it as host
    and path. Other urls are blocked if the
    posterior bad rate of their host is above `limit` by `z` deviations. `outcomes` (host, bad 0/1) are the
    labelled pages; by default, the pages that a rule judges. A host without outcomes takes its registered
    domain's posterior mean and strength as prior, that failing the suffix's, that failing all's; without
    any outcome it is allowed. At most MAX_RULES rules.

    Null urls and urls without :// have empty host and path and no rule. Repeated rows are separate
    outcomes. An empty table gives an empty table.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    whole, given = packed(pages, ("host", "path", "rule", "verdict"))
    url = F.col(field(pages, url_col))
    rows = whole.select("row", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, said = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(said)
    rows = rows.withColumn("rule", rule).withColumn("_said", said)
    if outcomes is None:
        outcomes = rows.where(F.col("_said").isNotNull()).select("host", (F.col("_said") == "block").cast("int").alias("bad"))
    hosts, domains, suffixes, top = host_reputation(outcomes)
    # One row per host that has no verdict yet: its own posterior, else the nearest ancestor's as prior.
    ask = rows.where(F.col("_said").isNull()).select("host").distinct().select("host", _label(F.col("host"), 2).alias("domain"), _label(F.col("host"), 1).alias("suffix"))
    prior = lambda t, on, x: t.select(*on, (F.col("a") / (F.col("a") + F.col("b")) * F.col("k")).alias(f"_a{x}"), (F.col("b") / (F.col("a") + F.col("b")) * F.col("k")).alias(f"_b{x}"))
    ask = ask.join(hosts.select("host", F.col("a").alias("_a0"), F.col("b").alias("_b0")), "host", "left").join(prior(domains, ["domain", "suffix"], 1), ["domain", "suffix"], "left")
    ask = ask.join(prior(suffixes, ["suffix"], 2), "suffix", "left").crossJoin(F.broadcast(prior(top, [], 3)))  # one row
    a, b = (F.coalesce(*[F.col(f"_{x}{i}") for i in range(4)]) for x in "ab")
    bad = ask.where(_bound(a, b, z) > limit).select(F.col("host").alias("_bad"))
    # Only blocked hosts are joined back.
    # Judged rows would all meet on one null key: theirs is a hash that no host is.
    key = F.when(F.col("_said").isNull(), F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64("path", "host").cast("string")))
    rows = rows.join(bad, key == F.col("_bad"), "left")
    return rows.select(*unpacked(pages, given), "host", "path", "rule", F.coalesce("_said", F.when(F.col("_bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op6_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


QUERIES = {"op6_url_filter": op6_url_filter}


def _sql() -> str:
    strength = lambda: "least(greatest(coalesce(1 / greatest(CASE WHEN pbad / pn * (1 - pbad / pn) > 0 AND pn > g THEN (sq / pn - pbad / pn * (pbad / pn) - pbad / pn * (1 - pbad / pn) * g / pn) / (pbad / pn * (1 - pbad / pn) * (1 - g / pn)) END, 1e-9) - 1, 1.0), 1.0), 1000.0)"
    sums = "sum(bad) AS pbad, sum(n) AS pn, count(*)::DOUBLE AS g, sum(bad * bad / n) AS sq"
    cases = lambda get: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{get(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    return rf"""
    WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
    r AS (SELECT *, {cases(lambda v, h, p: h + p)} AS rule, {cases(lambda v, h, p: v)} AS said, list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix FROM u),
    h AS (SELECT host, domain, suffix, sum((said = 'block')::INT)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM r WHERE said IS NOT NULL GROUP BY ALL),
    d0 AS (SELECT domain, suffix, {sums} FROM h GROUP BY ALL),
    d AS (SELECT domain, suffix, pbad AS bad, pn AS n, {strength()} AS k FROM d0),
    s0 AS (SELECT suffix, {sums} FROM d GROUP BY ALL),
    s AS (SELECT suffix, pbad AS bad, pn AS n, {strength()} AS k FROM s0),
    t0 AS (SELECT {sums} FROM s),
    t AS (SELECT (pbad + 1) / (pn + 2) AS m, {strength()} AS k FROM t0),
    sp AS (SELECT suffix, t.m * t.k + bad AS a, (1 - t.m) * t.k + n - bad AS b, s.k FROM s, t),
    dp AS (SELECT domain, suffix, sp.a / (sp.a + sp.b) * sp.k + bad AS a, sp.b / (sp.a + sp.b) * sp.k + n - bad AS b, d.k FROM d JOIN sp USING (suffix)),
    hp AS (SELECT host, dp.a / (dp.a + dp.b) * dp.k + bad AS a, dp.b / (dp.a + dp.b) * dp.k + n - bad AS b FROM h JOIN dp USING (domain, suffix)),
    q AS (SELECT DISTINCT host, domain, suffix FROM r),
    p AS (SELECT q.host, coalesce(hp.a, dp.a / (dp.a + dp.b) * dp.k, sp.a / (sp.a + sp.b) * sp.k, (SELECT m * k FROM t)) AS a, coalesce(hp.b, dp.b / (dp.a + dp.b) * dp.k, sp.b / (sp.a + sp.b) * sp.k, (SELECT (1 - m) * k FROM t)) AS b
          FROM q LEFT JOIN hp ON q.host = hp.host LEFT JOIN dp ON q.domain = dp.domain AND q.suffix = dp.suffix LEFT JOIN sp ON q.suffix = sp.suffix)
    SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM r JOIN p ON r.host = p.host"""


SQL = {"op6_url_filter": _sql()}
