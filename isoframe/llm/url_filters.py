"""URL rules by host-suffix and path-prefix expressions.

Each distinct URL is expanded into every pair of a host suffix (at label borders) and a path prefix; expressions meet the
rules by an equi-join on a short hash prefix, full digests confirm, and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import ascii_lower, free, small, written

#: Hex digits of the digest that the join compares first.
PREFIX = 8
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Verdict where no rule fits.
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule_host string, rule_path string")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict added.

    The host is what follows the first ``://``, with A-Z lower-cased; a null url, or one without ``://``, has an empty
    host and path and gets the default verdict. A rule fits its host and all its subdomains where the path starts with the
    rule's; the longest (host and path together, then host) wins, and of equal rules a blocking one. Columns of ``pages``
    named like the added ones are replaced. Copies of a url are judged once. No rules, or no pages, are no error.
    """
    spark = pages.sparkSession
    added = ["host", "path", "rule", "verdict"]
    rest = [c for c in pages.columns if c not in added]
    # the lengths that rule paths have (a few dozen at most: a length is below the longest rule's)
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect() if r[0] is not None)
    # and the numbers of labels that rule hosts have: only such suffixes can fit
    depths = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect() if r[0] is not None and r[0] > 0)
    digest = lambda h, p: F.sha2(F.concat(h, p), 256)
    coded = rules.select("verdict", "rule_host", "rule_path", digest(F.col("rule_host"), F.col("rule_path")).alias("full"))
    coded = small(written(coded.withColumn("short", F.substring("full", 1, PREFIX)), "rules"))

    urls = pages.select(F.col(url).alias("u")).where(F.col("u").isNotNull()).distinct()
    urls = urls.withColumns({"h": host_of(F.col("u")), "p": path_of(F.col("u"))}).where("h <> ''")
    labels = F.split("h", r"\.")
    suffixes = F.array_compact(F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in depths])) if depths else F.array().cast("array<string>")
    prefixes = F.array_distinct(F.array(*[F.substring("p", 1, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    expanded = urls.select("u", "h", F.explode(suffixes).alias("sh"), "p").select("u", "sh", F.explode(prefixes).alias("sp"))
    expanded = expanded.withColumn("full", digest(F.col("sh"), F.col("sp"))).withColumn("short", F.substring("full", 1, PREFIX))
    fits = expanded.alias("e").join(coded.alias("r"), "short").where("e.full = r.full AND e.sh = r.rule_host AND e.sp = r.rule_path")
    weight = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.col("verdict"))
    best = fits.groupBy("u").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict")), weight).alias("b"))
    own, of, said = free(pages, "__own", "__of", "__said")
    best = best.select(F.col("u").alias(of), F.col("b.rule").alias("rule"), F.col("b.verdict").alias(said))
    rows = pages.select(*rest, F.col(url).alias(own)).join(best, F.col(own) == F.col(of), "left")
    return rows.withColumns({"host": host_of(F.col(own)), "path": path_of(F.col(own)), "verdict": F.coalesce(said, F.lit(default))}).select(*rest, *added)


ORACLE_SQL = """
WITH rules(rverdict, rhost, rpath) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
parts AS (SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
fit AS (SELECT p.*, r.rhost || r.rpath AS rule, r.rverdict,
    row_number() OVER (PARTITION BY page_id, url ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS n
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fit WHERE n = 1
"""
