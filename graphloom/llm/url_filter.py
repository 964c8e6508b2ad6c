"""URL filters by host-suffix and path-prefix expressions.

Every distinct URL is expanded into the expressions ``suffix + path prefix`` that a rule could equal: all
label suffixes of its host, and the prefixes of its path whose length some rule's path has. The
expressions meet the rules in an equi-join on the first four bytes of their SHA-256; matches are confirmed
by the full digest, and the longest rule wins (of a rule given as both allow and block, block).

Nulls and odd rows: a null URL, or one without ``://``, has an empty host and path and fits no rule. Rules
with a null host, path or verdict are ignored. Repeated rows of pages are all kept with the same verdict. Other columns
of the pages stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import table

#: host, path, verdict; the contract's rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Rules are sent to all executors up to this count of rows; more of them are joined by a shuffle.
BROADCAST_RULES = 200_000

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(urls: DataFrame) -> DataFrame:
    """``u`` with its host and path."""
    rest = urls.withColumn("rest", F.expr("CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END"))
    return rest.select(
        "u",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), *LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def expressions(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """u and one row for each host suffix and path prefix."""
    return (
        urls.withColumn("labels", F.split("host", r"\.", -1))
        .withColumn("suffix", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")))
        .filter("suffix <> ''")
        .withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths])))
        .filter(F.length("path") >= F.col("n"))
        .select("u", F.concat_ws(" ", "suffix", F.expr("substr(path, 1, n)")).alias("expression"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``rules`` has host, path, verdict. ``default`` is the verdict where no rule fits.
    """
    rules = rules.select("host", "path", "verdict").na.drop()
    rules = rules.withColumn("host", F.translate("host", *LOWER)).groupBy("host", "path").agg(F.max("verdict").alias("rv"))
    rules = rules.select(F.concat("host", "path").alias("rule"), F.length("path").alias("rl"), "rv", F.sha2(F.concat_ws(" ", "host", "path"), 256).alias("rd")).withColumn("short", F.substring("rd", 1, 8))
    lengths = sorted(r[0] for r in rules.select("rl").distinct().collect())  # as many as the longest path has characters at most
    few = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    urls = parsed(pages.select(F.col("url").alias("u")).filter("u IS NOT NULL").distinct())
    if lengths:
        found = expressions(urls, lengths).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8))
        hits = found.join(F.broadcast(rules.drop("rl")) if few else rules, "short").filter("digest = rd")
        best = hits.groupBy("u").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rv")).alias("best"))
        urls = urls.join(best, "u", "left").select("u", "host", "path", F.col("best.rule").alias("rule"), F.col("best.rv").alias("rv"))
    else:
        urls = urls.select("u", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rv"))
    return pages.select("page_id", "url").join(urls, F.col("url") == F.col("u"), "left").select(
        "page_id",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("rv", F.lit(default)).alias("verdict"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP10_SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS k FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
b AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.rv, 'allow') AS verdict FROM p LEFT JOIN b USING (k)
"""
