"""URL filter: rules first; elsewhere, trust and distrust spread over links between hosts.

Hosts with allowed pages seed a personalised PageRank along links; hosts with blocked pages seed one along
reversed links. A host's seed is its share of allowed or blocked pages among those that a rule judges. A
host is blocked where its distrust exceeds RATIO times its trust. Only DataFrame functions; masses are
doubles that spread until none changes by more than SETTLED of itself, so neither the links of a hub nor the
distance from a seed end them; they are compared up to TIE, so that the order of summation doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING_PERCENT = 85
ROUNDS = 8
MASS = 1_000_000
RATIO_PERCENT = 100
STEP = 4
SETTLED, TIE = 1e-10, 1e-8
MOST_ROUNDS = 4600  # after these, what is left to come of any seed, shrunk by the damping each round, is less than the least double
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules, what: int) -> Column:
    """The longest rule that fits (what 0: its name, 1: its verdict), else null."""
    out = F.lit(None).cast("string")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.lit(verdict if what else name + start)).otherwise(out)
    return out


def judged(pages: DataFrame, rules) -> DataFrame:
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return p.select("*", by_rule(F.col("host"), F.col("path"), rules, 0).alias("rule"), by_rule(F.col("host"), F.col("path"), rules, 1).alias("by_rule"))


def host_links(pages: DataFrame) -> DataFrame:
    """a, b, w: host a links w times to host b."""
    found = F.regexp_extract_all(F.col("html"), F.lit("href=[\"']([^\"']*://[^\"']*)[\"']"), F.lit(1))
    links = pages.where(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("a"), F.explode(found).alias("to"))
    links = links.select("a", host_of(F.col("to")).alias("b")).where("a <> '' and b <> '' and a <> b")
    return links.groupBy("a", "b").agg(F.count("*").alias("w"))


def host_scores(pages: DataFrame, rules) -> DataFrame:
    """host, trust, distrust (in parts of MASS, rounded down), blocked, of the hosts that have either."""
    seeds = judged(pages, rules).where("host <> '' and by_rule is not null").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("good").alias("n")), F.struct(F.lit(1).alias("kind"), F.col("bad").alias("n")))
    seeds = seeds.select("host", (F.col("good") + F.col("bad")).alias("all"), F.explode(kinds).alias("x")).select("x.kind", "host", "x.n", "all").where("n > 0")
    rest = 100 - DAMPING_PERCENT
    seeds = written(seeds.select("kind", "host", F.expr(f"double(n) * {rest} / (double(`all`) * 100)").alias("own"), F.expr(f"({MASS} * n div `all`) * {rest} div 100").alias("shown")))
    own = seeds.select("kind", "host", F.col("own").alias("mass"))
    scores, nothing = own, F.lit(0.0)
    links = written(host_links(pages))
    if not links.isEmpty():
        both = links.select(F.lit(0).alias("kind"), "a", "b", "w").union(links.select(F.lit(1).alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        out = both.groupBy("kind", "a").agg(F.sum("w").alias("total"))
        both = written(both.join(out, ["kind", "a"]).select("kind", "a", "b", F.expr(f"double(w) * {DAMPING_PERCENT} / (double(total) * 100)").alias("share")))
        last = None
        for _ in range(MOST_ROUNDS // STEP):
            start = scores.select("kind", "host", nothing.alias("mass"), F.col("mass").alias("before"))
            for turn in range(STEP):
                held = scores.select("kind", F.col("host").alias("a"), "mass")
                sent = held.join(both, ["kind", "a"]).select("kind", F.col("b").alias("host"), (F.col("mass") * F.col("share")).alias("mass"))
                rows = own.union(sent).select("*", nothing.alias("before"))
                if turn + 1 == STEP:
                    rows = rows.union(start)
                scores = rows.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("before").alias("before"))
            old, scores = last, written(scores)
            last = scores.table_path
            if old:
                delete(pages.sparkSession, old)
            if scores.where(F.col("mass") - F.col("before") > F.col("mass") * SETTLED).isEmpty():
                break
    both = scores.select("kind", "host", "mass", nothing.alias("own"), F.lit(0).cast("long").alias("shown")).union(seeds.select("kind", "host", nothing.alias("mass"), "own", "shown"))
    of = lambda k, c: F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0))
    both = both.groupBy("host").agg(*[of(k, c).alias(f"{c}_{k}") for k in (0, 1) for c in ("mass", "own", "shown")])
    points = lambda k: F.col(f"shown_{k}") + F.floor(F.greatest(F.col(f"mass_{k}") - F.col(f"own_{k}"), nothing) * MASS + 1e-6)
    blocked = F.col("mass_1") * 100 > F.col("mass_0") * RATIO_PERCENT * (1 + TIE)
    return both.select("host", points(0).alias("trust"), points(1).alias("distrust"), blocked.alias("blocked"))


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A null url or one without :// has an empty host and path, no rule, and is allowed. Null html has no links.
    Equal lengths of rules: the later one in the list wins. Repeated rows are judged each; extra columns
    are ignored; an empty table gives an empty result. trust and distrust are rounded down, to 0 where they are
    small; the verdict is by what they were before.
    """
    scores = host_scores(pages, rules)
    out = judged(pages, rules).join(scores, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0).cast("long"))).withColumn("distrust", F.coalesce("distrust", F.lit(0).cast("long")))
    spread = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", spread).alias("verdict"), "trust", "distrust")


def oracle(rules=RULES) -> str:
    """In DuckDB's SQL, with ROUNDS rounds of whole masses: the same where pages hold no links to other hosts."""

    def host(x):
        return f"coalesce(translate(regexp_extract({x}, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"

    cases = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    when = lambda f: "CASE " + " ".join(f"WHEN (host = '{n}' OR host LIKE '%.{n}') AND starts_with(path, '{s}') THEN '{f(v, n, s)}'" for v, n, s in cases) + " ELSE NULL END"
    steps, rest = [], 100 - DAMPING_PERCENT
    for i in range(ROUNDS):
        steps.append(f"s{i + 1} AS (SELECT kind, host, sum(mass)::BIGINT AS mass FROM (SELECT * FROM s0 UNION ALL SELECT e.kind, e.b AS host, s.mass * e.w * {DAMPING_PERCENT} // (e.total * 100) AS mass FROM s{i} s JOIN e ON s.kind = e.kind AND s.host = e.a) GROUP BY ALL)")
    return f"""WITH p AS (SELECT *, {when(lambda v, n, s: n + s)} AS rule, {when(lambda v, n, s: v)} AS by_rule FROM (SELECT page_id, {host('url')} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, url, html FROM pages)),
seeds AS (SELECT host, count(*) FILTER (by_rule = 'allow') AS good, count(*) FILTER (by_rule = 'block') AS bad FROM p WHERE host <> '' AND by_rule IS NOT NULL GROUP BY host),
s0 AS (SELECT kind, host, (seed * {rest} // 100)::BIGINT AS mass FROM (SELECT 0 AS kind, host, ({MASS} * good) // (good + bad) AS seed FROM seeds UNION ALL SELECT 1, host, ({MASS} * bad) // (good + bad) FROM seeds) WHERE seed > 0),
l AS (SELECT a, b, count(*) AS w FROM (SELECT host AS a, {host('t')} AS b FROM (SELECT host, unnest(regexp_extract_all(html, 'href=["'']([^"'']*://[^"'']*)["'']', 1)) AS t FROM p)) WHERE a <> '' AND b <> '' AND a <> b GROUP BY ALL),
k AS (SELECT 0 AS kind, a, b, w FROM l UNION ALL SELECT 1, b, a, w FROM l),
e AS (SELECT *, sum(w) OVER (PARTITION BY kind, a)::BIGINT AS total FROM k),
{', '.join(steps)},
h AS (SELECT host, coalesce(sum(mass) FILTER (kind = 0), 0)::BIGINT AS trust, coalesce(sum(mass) FILTER (kind = 1), 0)::BIGINT AS distrust FROM s{ROUNDS} GROUP BY host)
SELECT page_id, p.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(distrust, 0) * 100 > coalesce(trust, 0) * {RATIO_PERCENT} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust FROM p LEFT JOIN h ON p.host = h.host"""
