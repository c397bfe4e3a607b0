"""URL filters by host rules and link-graph propagation; DataFrame functions only.

Rules name a host and a path prefix.  Pages that no rule fits are judged by their
host: trust flows from hosts whose pages are mostly allowed along links
(personalised PageRank), distrust flows from hosts whose pages are mostly blocked
against links (who links to bad hosts is suspect).  A host whose distrust exceeds
its trust by more than a ratio is blocked.

Mass is held in whole units (10^12 for each seed, in decimals), so sums don't depend
on their order, reruns agree, and small shares of many seeds don't vanish.

Hosts with many pages meet their rules and scores by broadcast (``scratch.hot_join``); their pages stay where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.scratch import drop, hot_join, hot_keys, own, stash

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UNITS = 10**12
DAMPING = 0.85
#: Rounds end when the mass moved in ``STRIDE`` of them is no more than this part of all, or at the last one.
ROUNDS, STRIDE, TOLERANCE = 60, 4, 1e-3
_MASS = "decimal(38,0)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Absolute and protocol-relative links of a page.
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("rule_verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host) -> (rule_of, rules): the rules of each host that has any, by joining its suffixes."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.explode(suffixes).alias("rule_host"))
    met = each.join(rules, "rule_host")
    rule = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("hn"), F.concat("rule_host", "rule_path").alias("name"), "rule_path", "rule_verdict")
    return met.groupBy(F.col("host").alias("rule_of")).agg(F.collect_set(rule).alias("rules"))


def judge_by_rule(pages: DataFrame, rules: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(..., host, path) -> the same with rule and rule_verdict of the longest fitting rule, else null."""
    found = _host_rules(pages.select("host").distinct(), rules).withColumnRenamed("rule_of", "host")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    met = hot_join(pages, found, "host", hot).withColumn("best", best)
    return met.select(*pages.columns, F.col("best.name").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(host, html) -> (src, dst, links) between different hosts."""
    each = pages.where(F.col("html").rlike(_LINK)).select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    each = each.withColumn("dst", F.translate("dst", UPPER, LOWER)).where((F.col("src") != F.col("dst")) & (F.col("src") != ""))
    return each.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, kind 'trust' or 'distrust') seeds -> (host, kind, mass), ``UNITS`` of mass coming from each seed.

    Trust follows links; distrust goes from a page to those that link to it.
    Each round is one equi-join on the host and one sum, which is aggregated before its shuffle.  No edges: mass stays
    with the seeds.
    """
    start = stash(seeds.select("host", "kind", F.lit(UNITS).cast(_MASS).alias("mass")), "seeds")
    if edges.isEmpty():
        return start
    both = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), "links", F.lit("trust").alias("kind")).unionAll(edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), "links", F.lit("distrust").alias("kind")))
    total = both.groupBy("host", "kind").agg(F.sum("links").alias("all_links"))
    parts = stash(both.join(total, ["host", "kind"]).select("host", "kind", "to", (F.col("links").cast("double") / F.col("all_links")).alias("part")), "link-parts")
    back = start.select("host", "kind", F.floor(F.col("mass").cast("double") * (1 - damping)).cast(_MASS).alias("mass"))
    now, held = start, start
    for i in range(1, rounds + 1):
        sent = now.join(parts, ["host", "kind"]).select(F.col("to").alias("host"), "kind", F.floor(F.col("mass").cast("double") * damping * F.col("part")).cast(_MASS).alias("mass"))
        now = sent.unionAll(back).groupBy("host", "kind").agg(F.sum("mass").cast(_MASS).alias("mass"))
        if i % STRIDE and i < rounds:
            continue
        now = stash(now, "link-mass")
        change = now.unionAll(held.withColumn("mass", (-F.col("mass")).cast(_MASS))).groupBy("host", "kind").agg(F.sum("mass").alias("d"))
        moved = change.agg(F.sum(F.abs("d").cast("double"))).first()[0] or 0
        whole = now.agg(F.sum(F.col("mass").cast("double"))).first()[0] or 0
        if held is not start:
            drop(held)
        held = now
        if moved <= tolerance * whole:
            break
    return now


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 1.0, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, trust, distrust.

    ``verdict`` is the rule's, else 'block' where the host's distrust is over ``ratio``
    times its trust, else 'allow'; both are shares of all seeds' mass.  A null url, or one without ``://``, has an empty
    host and path and is allowed unless a rule fits; a null page has no links, a very long one all of its own.  Repeated
    rows are all returned.  An empty table gives no rows.  Other columns are ignored.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    rows = own(pages, id=id_col, host=host(F.col(f"`{url_col}`")), path=path(F.col(f"`{url_col}`")), html=html_col)
    held = stash(rows.drop("html"), "page-urls")
    hot = stash(hot_keys(held, "host"), "hot-hosts")
    judged = stash(judge_by_rule(held, rules, hot), "judged-pages")
    share = judged.groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"))
    kind = F.when(F.col("bad") > F.col("good"), "distrust").when(F.col("good") > 0, "trust")
    seeds = stash(share.where("host <> ''").select("host", kind.alias("kind")).where("kind IS NOT NULL"), "host-seeds")
    many = {r[0]: r[1] for r in seeds.groupBy("kind").count().collect()}
    mass = propagate(seeds, stash(host_edges(rows), "host-edges"), damping, rounds)
    of = lambda k: (F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).cast("double") / F.lit(float(many.get(k, 1)))).alias(k)
    scores = stash(mass.groupBy("host").agg(of("trust"), of("distrust")), "host-scores")
    out = hot_join(judged, scores, "host", hot)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("rule_verdict", F.when(distrust > trust * ratio, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), (trust / UNITS).alias("trust"), (distrust / UNITS).alias("distrust"))


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``pages``: the verdicts with ``ratio`` 1, after all rounds."""
    table = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    steps = "".join(
        f"""m{i + 1} AS MATERIALIZED (
  SELECT host, kind, sum(mass)::HUGEINT AS mass FROM (
    SELECT p.dst AS host, p.kind, floor(m.mass::DOUBLE * {damping}::DOUBLE * p.part)::HUGEINT AS mass FROM m{i} m JOIN parts p ON m.host = p.host AND m.kind = p.kind
    UNION ALL SELECT host, kind, floor(mass::DOUBLE * (1 - {damping}::DOUBLE))::HUGEINT FROM m0) GROUP BY host, kind),
"""
        for i in range(rounds)
    )
    link = _LINK.replace("'", "''")
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {table}),
pg AS MATERIALIZED (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS rid FROM pages),
fit AS (SELECT rid, rh || rp AS rule, rv, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC) AS rn
  FROM pg JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
j AS MATERIALIZED (SELECT pg.*, fit.rule, fit.rv FROM pg LEFT JOIN fit ON pg.rid = fit.rid AND fit.rn = 1),
sh AS (SELECT host, CASE WHEN count(*) FILTER (WHERE rv = 'block') > count(*) FILTER (WHERE rv = 'allow') THEN 'distrust'
        WHEN count(*) FILTER (WHERE rv = 'allow') > 0 THEN 'trust' END AS kind FROM j WHERE host <> '' GROUP BY host),
m0 AS MATERIALIZED (SELECT host, kind, {UNITS}::HUGEINT AS mass FROM sh WHERE kind IS NOT NULL),
nn AS (SELECT coalesce(nullif(count(*) FILTER (WHERE kind = 'trust'), 0), 1) AS nt, coalesce(nullif(count(*) FILTER (WHERE kind = 'distrust'), 0), 1) AS nd FROM m0),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM pg),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS links FROM links WHERE src <> dst AND src <> '' GROUP BY src, dst),
both_ways AS (SELECT src AS host, dst, links, 'trust' AS kind FROM edges UNION ALL SELECT dst, src, links, 'distrust' FROM edges),
parts AS MATERIALIZED (SELECT host, kind, dst, links::DOUBLE / sum(links) OVER (PARTITION BY host, kind) AS part FROM both_ways),
{steps}sc AS (SELECT host, coalesce(max(mass) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(max(mass) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM
  (SELECT * FROM m{rounds} WHERE (SELECT count(*) FROM edges) > 0
   UNION ALL SELECT * FROM m0 WHERE (SELECT count(*) FROM edges) = 0) GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.rv, CASE WHEN coalesce(sc.distrust, 0)::DOUBLE / nn.nd > coalesce(sc.trust, 0)::DOUBLE / nn.nt THEN 'block' ELSE 'allow' END) AS verdict
FROM j CROSS JOIN nn LEFT JOIN sc ON j.host = sc.host
"""
