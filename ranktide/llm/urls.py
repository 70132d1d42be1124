"""URL filters: host-suffix and path-prefix expressions met with rules by short hash prefixes.

A rule is a host, a path and a verdict.  It fits a url whose host is the rule's or a subdomain of it and whose path starts with the
rule's.  A url is expanded into expressions, a suffix of its host's labels joined to a prefix of its path, for every shape
(number of labels, length of the path) that some rule has: only such expressions can be equal to a rule.  The first 32 bits of
the expression's SHA-256 are joined to those of the rules; a candidate counts if all 256 bits agree.  Of the rules that fit
the longest wins, then the one with the longer host, then block before allow.

Verdicts are found once for each distinct (host, path), so that copies of a url are expanded once, and joined back.  Rules are sent to the
tasks only if there are at most ``RULES_SENT`` of them, which are counted; beyond that both sides are shuffled by the hash prefix.

Nulls and edges: a null url, or one without ``://``, has an empty host and path; a url that no rule fits, or with an empty rule
table, has a null rule and the ``otherwise`` verdict; rules with a null host or verdict are left out, a null path of a rule is
empty; only A to Z are lower-cased; repeated rows get equal rows; columns host, path, rule and verdict of the input are replaced, other columns pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_SENT = 200_000
OTHERWISE = "allow"
#: Fixed values of the contract: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)://(.*)", 1)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _keyed(expression: Column) -> tuple[Column, Column]:
    digest = F.sha2(expression, 256)
    return F.substring(digest, 1, 8), digest


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path), distinct, and rules (verdict, host, path) -> host, path, rule, verdict of those that a rule fits."""
    r = rules.filter("host is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    r = r.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block before allow
    r = r.withColumn("r_labels", F.size(F.split("r_host", r"\.")))
    near, digest = _keyed(F.concat("r_host", "r_path"))
    r = r.withColumns({"r_near": near, "r_digest": digest})
    # at most as many shapes as label counts times path lengths of the rules, in one value
    shapes = r.agg(F.collect_set(F.struct(F.col("r_labels").alias("labels"), F.length("r_path").alias("length"))).alias("shapes"))
    e = urls.select("host", "path", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"), shapes.scalar().alias("shapes"))
    fits = F.filter("shapes", lambda s: (s["labels"] <= F.col("labels")) & (s["length"] <= F.col("length")))
    e = e.select("host", "path", F.explode(fits).alias("s"))
    e = e.select("host", "path", F.expr("concat(substring_index(host, '.', -s.labels), left(path, s.length))").alias("expression"), "s.labels")
    near, digest = _keyed(F.col("expression"))
    e = e.select("host", "path", "labels", near.alias("near"), digest.alias("digest"))
    if r.count() <= RULES_SENT:
        r = F.broadcast(r)
    hits = e.join(r, F.col("near") == F.col("r_near")).filter((F.col("digest") == F.col("r_digest")) & (F.col("labels") == F.col("r_labels")))
    rule = F.concat("r_host", "r_path")
    first = F.max(F.struct(F.length(rule), F.length("r_host"), F.col("r_verdict"), rule.alias("rule"))).alias("best")
    return hits.groupBy("host", "path").agg(first).select("host", "path", "best.rule", F.col("best.r_verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """The pages with host, path, rule (host and path of the winning rule) and verdict."""
    host, path = host_and_path(F.coalesce(F.col(url), F.lit("")))
    d = pages.select(F.struct(*pages.columns).alias("row"), host.alias("host"), path.alias("path"))
    v = verdicts(d.select("host", "path").distinct(), rules).withColumnsRenamed({"host": "v_host", "path": "v_path"})
    d = d.join(v, (F.col("host") == F.col("v_host")) & (F.col("path") == F.col("v_path")), "left")
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return d.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH p AS (SELECT row_number() OVER () AS row_id, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT row_id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
fit AS (
  SELECT row_id, r.host || r.path AS rule, verdict, row_number() OVER (PARTITION BY row_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fit ON u.row_id = fit.row_id AND k = 1
"""
