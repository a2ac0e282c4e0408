"""URL filters: rules by host and path, and for all other urls a verdict on the host from the link graph.

Method: link-graph propagation. Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule
blocks are blocked seeds, each by its number of such pages. Trust is a personalised PageRank from the trusted seeds along
the links between hosts; distrust one from the blocked seeds along the links reversed (who links to the blocked is
suspect). A host is blocked if its distrust is more than `ratio` times its trust and its share of all pages together.
DataFrame functions only.

Scale: pages shrink to counts by host and by pair of hosts before anything iterates; both ranks are one table, so a step
is one join and one aggregation over host edges, written to the shared folder to end lineage. Pages meet the verdicts by
a join on the host, whose skewed partitions Spark splits; urls are shuffled, texts are not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""
#: Up to so many rules make one expression; more are joined by host.
CHAIN = 200
DAMPING, RATIO = 0.85, 4.0
#: Ranks are done when a step moves less than this share of all rank; a step moves at most DAMPING times the one before.
TOLERANCE, MOST_STEPS = 1e-9, 500


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no `://`."""
    at = F.coalesce(F.locate("://", url) if isinstance(url, str) else F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """Adds (rule, rule_verdict) to rows with host and path: of the rules that fit, the longest (ties: by name)."""
    best = sorted(dict.fromkeys(rules), key=lambda r: (-len(r.name), r.name, r.verdict))
    if len(best) <= CHAIN:
        name = verdict = F.lit(None).cast("string")
        for r in reversed(best):
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
        return pages.withColumns({"rule": name, "rule_verdict": verdict})
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.name, r.verdict, k) for k, r in enumerate(best)], "_rh string, _rp string, _rn string, _rv string, _rk int")
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = urls.withColumn("_rh", F.explode(ends)).join(table, "_rh").where(F.col("path").startswith(F.col("_rp")))
    first = fits.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.min(F.struct("_rk", "_rn", "_rv")).alias("_best"))
    joined = pages.join(first, (pages.host == F.col("_h")) & (pages.path == F.col("_p")), "left")
    return joined.select(*pages.columns, F.col("_best._rn").alias("rule"), F.col("_best._rv").alias("rule_verdict"))


def host_links(pages: DataFrame, html_col: str) -> DataFrame:
    """Links between different hosts: (src, dst, n), from rows with host and html."""
    links = pages.where("host <> ''").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1))).alias("dst")
    )
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Ranks (kind, host, score). seeds: (kind, host, share) with shares of 1 in sum for each kind, trust or distrust.

    Trust follows links, distrust follows them backwards. What a host without onward links holds returns to the seeds.
    Steps go on until one moves less than `tolerance`; beyond MOST_STEPS it raises.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v"), "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("u"), F.col("src").alias("v"), "n")
    )
    totals = both.groupBy("kind", "u").agg(F.sum("n").alias("t"))
    edges = written(both.join(totals, ["kind", "u"]).select("kind", "u", "v", (F.col("n") / F.col("t")).alias("w")), "links")
    ranks = written(seeds.select("kind", "host", F.col("share").alias("score")), "ranks")
    if edges.isEmpty():
        return ranks
    seeds = written(seeds, "seeds")
    for _ in range(MOST_STEPS):
        onward = (
            ranks.join(edges, (ranks.kind == edges.kind) & (ranks.host == edges.u))
            .groupBy(edges.kind, F.col("v").alias("host"))
            .agg(F.sum(F.col("score") * F.col("w")).alias("flow"))
        )
        moved = onward.groupBy("kind").agg(F.sum("flow").alias("moved"))
        back = seeds.join(F.broadcast(moved), "kind", "left").select(  # two rows at most
            "kind", "host", (F.col("share") * (1 - F.lit(damping) * F.coalesce("moved", F.lit(0.0)))).alias("score")
        )
        new = back.unionByName(onward.select("kind", "host", (F.col("flow") * damping).alias("score")))
        new = written(new.groupBy("kind", "host").agg(F.sum("score").alias("score")), "ranks")
        old = ranks.select("kind", "host", F.col("score").alias("was"))
        change = new.join(old, ["kind", "host"], "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        ranks = new
        if not change or change < tolerance:
            return ranks
    raise RuntimeError(f"propagated: ranks still move after {MOST_STEPS} steps")


def judged(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO
) -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row.

    verdict: that of the longest rule that fits host (or a parent domain) and path, else block for hosts whose distrust
    outweighs, else allow. Urls without a host fit no rule and are allowed. Null ids, urls and html are allowed; further
    columns are ignored.
    """
    host, path = host_path(F.col(url_col))
    base = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    urls = ruled(base.select("id", "host", "path"), rules)
    hosts = written(
        urls.where("host <> ''")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad")),
        "hosts",
    )
    sums = hosts.agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    shares = hosts.crossJoin(F.broadcast(sums))  # one row
    seeds = shares.where("good > 0").select(F.lit("trust").alias("kind"), "host", (F.col("good") / F.col("all_good")).alias("share")).unionByName(
        shares.where("bad > 0").select(F.lit("distrust").alias("kind"), "host", (F.col("bad") / F.col("all_bad")).alias("share"))
    )
    ranks = propagated(host_links(base, "html"), seeds)
    scores = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust")
    )
    blocked = (
        shares.select("host", (F.col("n") / F.col("all_n")).alias("share"))
        .join(scores, "host")
        .where(F.coalesce("distrust", F.lit(0.0)) > ratio * (F.coalesce("trust", F.lit(0.0)) + F.col("share")))
        .select("host", F.lit("block").alias("by_host"))
    )
    return urls.join(blocked, "host", "left").select("id", "host", "path", "rule", F.coalesce("rule_verdict", "by_host", F.lit("allow")).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def _sql() -> str:
    best = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in best]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, best, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, best, strict=True)) + " END"
    link = _LINK.replace("'", "''")
    # 0.85 ** 150 is below the tolerance
    return rf"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), p AS (SELECT page_id, html, host, path, {rule} AS rule, {verdict} AS rv FROM b
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (rv = 'allow') AS good, count(*) FILTER (rv = 'block') AS bad
  FROM p WHERE host <> '' GROUP BY host
), seeds AS (
  SELECT 'trust' AS kind, host, CAST(good AS DOUBLE) / (SELECT sum(good) FROM h) AS share FROM h WHERE good > 0
  UNION ALL SELECT 'distrust', host, CAST(bad AS DOUBLE) / (SELECT sum(bad) FROM h) FROM h WHERE bad > 0
), l AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM p WHERE host <> '')
  WHERE src <> dst GROUP BY src, dst
), bi AS (SELECT 'trust' AS kind, src AS u, dst AS v, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l
), e AS MATERIALIZED (SELECT kind, u, v, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY kind, u) AS w FROM bi
), r(step, kind, host, score) AS (
  SELECT 0, kind, host, share FROM seeds
  UNION ALL
  SELECT step, kind, host, sum(score) FROM (
    SELECT r.step + 1 AS step, e.kind, e.v AS host, {DAMPING} * r.score * e.w AS score FROM r JOIN e ON r.kind = e.kind AND r.host = e.u WHERE r.step < 150
    UNION ALL
    SELECT t.step + 1, seeds.kind, seeds.host, share * (1 - {DAMPING} * coalesce(m.moved, 0))
    FROM seeds CROSS JOIN (SELECT max(step) AS step FROM r) t
      LEFT JOIN (SELECT r.kind, sum(r.score * e.w) AS moved FROM r JOIN e ON r.kind = e.kind AND r.host = e.u GROUP BY r.kind) m ON m.kind = seeds.kind
    WHERE t.step < 150) GROUP BY step, kind, host
), z AS (SELECT kind, host, score FROM r WHERE step = 150
), x AS (
  SELECT h.host FROM h
  LEFT JOIN z t ON t.host = h.host AND t.kind = 'trust' LEFT JOIN z d ON d.host = h.host AND d.kind = 'distrust'
  WHERE coalesce(d.score, 0) > {RATIO} * (coalesce(t.score, 0) + CAST(h.n AS DOUBLE) / (SELECT sum(n) FROM h))
)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN host IN (SELECT host FROM x) THEN 'block' END, 'allow') AS verdict FROM p
"""


SQL = _sql()
