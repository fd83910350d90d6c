"""URL filters: rules first, then trust and distrust carried along the links between hosts.

1. A rule names a host and the beginning of a path. It is joined to the distinct hosts by
   their domain suffixes; of the rules that fit a url the longest wins.
2. Hosts are nodes; a page's absolute links and a host's bonds with the domain above it
   are edges. Trust is a personalised PageRank from the hosts whose pages rules allow,
   distrust one along reversed edges from those whose pages rules block, both in the
   same rounds: mass is a whole number, so sums don't hang on the order of rows and
   reruns agree to the unit.
3. Pages that no rule fits are blocked where their host's distrust outweighs its trust.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import materialise, table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Units of trust, and of distrust, that seeds share; rounds; of a hundred units of a node those that follow its edges; distrust a hundred units of trust outweigh.
TOTAL, ROUNDS, FOLLOW, RATIO = 10**15, 10, 85, 100

HREF = r"[hH][rR][eE][fF][\x20\x09-\x0D]*=[\x20\x09-\x0D]*[\"']?[\x20\x09-\x0D]*(?:[hH][tT][tT][pP][sS]?:)?//([^/?#\"'<>\x20\x09-\x0D\\]+)"


def _lowered(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def located(pages: DataFrame) -> DataFrame:
    """(page_id, url) -> page_id, host, path; both empty without a ``://``."""
    part = lambda pattern: F.coalesce(F.regexp_extract("url", pattern, 1), F.lit(""))
    return pages.select("page_id", _lowered(part(r"(?s)^.*?://([^/?#]*)")).alias("host"), part(r"(?s)^.*?://[^/?#]*([^?#]*)").alias("path"))


def _suffixes(host: Column) -> Column:
    """A host and the domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def by_rules(places: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path) -> the same, rule and verdict of the longest rule that fits (null: none); a row for each row.

    Of rules of one length the one with the longer host wins; a rule listed as allow and
    block blocks. Only distinct hosts meet the rules; a page brings its path to what its host may meet.
    """
    spark = places.sparkSession
    listed = spark.createDataFrame([(h, p, v, h + p) for v, h, p in rules], "suffix string, rule_path string, rule_verdict string, rule string")
    hosts = places.select("host").distinct().select("host", F.explode(_suffixes(F.col("host"))).alias("suffix"))
    rank = F.struct(F.length("rule").alias("length"), F.length("suffix").alias("host_length"), F.col("rule_verdict").alias("verdict"), "rule", F.col("rule_path").alias("path"))
    fitting = hosts.join(listed, "suffix").groupBy("host").agg(F.collect_set(rank).alias("fitting"))
    best = F.array_max(F.filter("fitting", lambda r: F.startswith(F.col("path"), r["path"])))
    rows = places.join(fitting, "host", "left").select("page_id", "host", "path", best.alias("best"))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def host_edges(pages: DataFrame, bonds: bool = True) -> DataFrame:
    """(url, html) -> distinct (src, dst): hosts of absolute links and, with ``bonds``, a host and the domain right above it, both ways.

    The domain above has two labels at least. Links within a host are left out.
    """
    named = pages.withColumn("page_id", F.lit(None))
    links = located(named.withColumn("page_id", F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)))).select("host", F.explode("page_id").alias("dst"))
    edges = links.select(F.col("host").alias("src"), _lowered(F.col("dst")).alias("dst"))
    if bonds:
        hosts = located(named).select("host").unionByName(edges.select(F.col("dst").alias("host"))).distinct()
        up = hosts.select(F.explode(F.filter(_suffixes(F.col("host")), lambda s: s.contains("."))).alias("src")).distinct()
        up = up.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst")).filter(F.col("dst").contains("."))
        edges = edges.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, follow: int = FOLLOW) -> DataFrame:
    """(src, dst), (kind, host, n) -> kind, host, mass.

    kind 'trust' follows edges, 'distrust' goes against them. Seeds share ``TOTAL`` in
    proportion to n; each round a node's mass, less what is not followed, goes to its
    neighbours in equal parts, and seeds get the rest anew. Divisions are rounded
    down; mass at nodes without an edge onwards ends there.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    both = materialise(both.join(degree, ["kind", "src"]).withColumnRenamed("src", "host"), "host-edges")
    all_of = seeds.groupBy("kind").agg(F.sum("n").alias("all_n"))
    start = materialise(seeds.join(F.broadcast(all_of), "kind").select("kind", "host", F.expr(f"({TOTAL}L div all_n) * n").alias("mass")), "seeds")
    again = start.select("kind", "host", F.expr(f"mass * {100 - follow} div 100").alias("mass"))
    mass = start
    for _ in range(rounds):
        moved = both.join(mass, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.expr(f"mass * {follow} div 100 div degree").alias("mass"))
        mass = materialise(moved.unionByName(again).groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "mass")
    return mass


def distrusted(mass: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(kind, host, mass) -> hosts whose distrust is above ``ratio`` hundredths of their trust."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(F.lit(0)))
    sums = mass.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    return sums.filter(F.expr(f"cast(distrust AS decimal(30)) * 100 > cast(trust AS decimal(30)) * {ratio}"))


def judge(pages: DataFrame, rules=RULES, bonds: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, url, html) -> page_id, host, path, rule, verdict, decided_by; a row for each row.

    A null url, or one without ``://``, has an empty host: no rule fits it, it is no
    node and it is allowed. Null html has no links. Repeated rows are repeated in the
    result and count as seeds each; an empty table gives none; further columns are
    ignored. Without seeds of a kind there is no mass of it.
    """
    ruled = materialise(by_rules(located(pages), rules), "ruled-pages")
    kind = F.when(F.col("verdict") == "allow", "trust").otherwise("distrust")
    seeds = ruled.filter("verdict IS NOT NULL AND host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    bad = distrusted(propagated(host_edges(pages, bonds), seeds, rounds)).select("host", F.lit("block").alias("spread"))
    found = ruled.join(bad, "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").when(F.col("spread").isNotNull(), "links").otherwise("default").alias("decided_by"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the verdict of every url of ``pages``."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The oracle: its rounds are written out one after another."""
    lower = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    href = HREF.replace("'", "''")
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    rounds = "".join(
        f""", m{i + 1} AS MATERIALIZED (
  SELECT kind, host, sum(mass)::BIGINT AS mass FROM (
    SELECT e.kind, e.dst AS host, mass * {FOLLOW} // 100 // degree AS mass FROM m{i} JOIN e ON m{i}.kind = e.kind AND m{i}.host = e.src
    UNION ALL SELECT kind, host, mass * {100 - FOLLOW} // 100 FROM m0
  ) GROUP BY kind, host
)"""
        for i in range(ROUNDS)
    )
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS rn, page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {lower}) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules AS (
  SELECT * FROM (VALUES {rules}) AS t(verdict, h, pre)
), fits AS (
  SELECT rn, h || pre AS rule, verdict, row_number() OVER (PARTITION BY rn ORDER BY length(h || pre) DESC, length(h) DESC, verdict DESC) AS place
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
), j AS (
  SELECT p.rn, page_id, host, path, rule, verdict FROM p LEFT JOIN fits ON p.rn = fits.rn AND place = 1
), l AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)), {lower}) AS dst FROM p
), hs AS (
  SELECT host FROM p UNION SELECT dst FROM l
), up AS (
  SELECT DISTINCT array_to_string(x[i:], '.') AS src, array_to_string(x[i + 1:], '.') AS dst
  FROM (SELECT string_split(host, '.') AS x FROM hs), (SELECT unnest(range(1, 300)) AS i) WHERE i <= len(x) - 2
), edges AS (
  SELECT DISTINCT src, dst FROM (SELECT src, dst FROM l UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up) WHERE src <> '' AND dst <> '' AND src <> dst
), b AS (
  SELECT 'trust' AS kind, src, dst FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges
), e AS MATERIALIZED (
  SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS degree FROM b
), s AS (
  SELECT CASE WHEN verdict = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM j WHERE verdict IS NOT NULL AND host <> '' GROUP BY ALL
), m0 AS MATERIALIZED (
  SELECT kind, host, ({TOTAL} // (sum(n) OVER (PARTITION BY kind))::BIGINT) * n AS mass FROM s
){rounds}, bad AS (
  SELECT host FROM m{ROUNDS} GROUP BY host
  HAVING sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END) * 100 > sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END) * {RATIO}
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""


SQL = _sql()
