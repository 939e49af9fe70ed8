"""URL filter: host-suffix and path-prefix expressions against a list of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, pick, settle

#: Hex digits of a digest that the equi-join compares; the whole digest is compared afterwards.
PREFIX_DIGITS = 8
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule_host string, rule_path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judges every row of ``pages`` (page_id, url) by ``rules`` (verdict, rule_host, rule_path).

    Returns page_id, host, path, rule, verdict. A rule fits its host and all its
    subdomains, where the URL's path starts with the rule's path. The longest rule
    (host and path together) wins; of two equal rules, a blocking one. Where no rule
    fits, rule is null and the verdict is ``default``.

    Nulls: a null URL, or one without '://', has an empty host and path, so only the
    default holds. Null page_ids and repeated rows stay as they are, a row each. Rules
    with a null in any column are left out. Empty tables give empty results.

    Each distinct (host, path) is expanded once, to those label counts and path
    lengths that some rule has; expressions meet rules on a short digest prefix,
    and the whole digest confirms. Only distinct pairs that some rule fits are
    joined back, so neither the rules nor a hot host need to fit one task.
    """
    urls = pick(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    listed = pick(rules, "verdict", "rule_host", "rule_path").dropna().distinct()
    listed = listed.select(
        "verdict",
        F.concat(ascii_lower(F.col("rule_host")), "rule_path").alias("rule"),
        F.size(F.split("rule_host", "\\.", -1)).alias("labels"),
        F.length("rule_path").alias("chars"),
    ).withColumn("digest", F.sha2("rule", 256))
    listed = listed.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    # Shapes are few: label counts times path lengths of the rules, never more than there are rules.
    shapes = listed.agg(F.collect_set(F.struct("labels", "chars")).alias("shapes"))
    pairs = urls.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", "\\.", -1)
    shaped = (
        pairs.join(F.broadcast(shapes))
        .withColumn("labels", labels)
        .withColumn("shape", F.explode(F.filter("shapes", lambda s: (s["labels"] <= F.size("labels")) & (s["chars"] <= F.length("path")))))
    )
    suffix = F.concat_ws(".", F.slice("labels", F.size("labels") - F.col("shape.labels") + 1, F.col("shape.labels")))
    sought = shaped.select("host", "path", F.sha2(F.concat(suffix, F.substring("path", F.lit(1), F.col("shape.chars"))), 256).alias("sought"))
    sought = sought.withColumn("prefix", F.substring("sought", 1, PREFIX_DIGITS))
    hits = sought.join(listed, "prefix").where(F.col("sought") == F.col("digest"))
    rank = F.struct(F.length("rule"), F.col("rule"), F.col("verdict"))  # 'block' sorts after 'allow'
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    # As a table of its own, so that Spark can split the pages of one URL over several tasks of the join.
    best, _ = settle(best, "best")
    out = urls.join(best.hint("merge"), (urls.host == best.h) & (urls.path == best.p), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark))


OP9_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut
), urls AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts
), rules(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT u.host, u.path, r.rh || r.rp AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.rh || r.rp) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM urls) u
  JOIN rules r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp)
)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN best b ON b.n = 1 AND u.host = b.host AND u.path = b.path
"""
