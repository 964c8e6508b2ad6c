"""Queries of drift, similarity, provenance and code facts, with their oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import scores
from graphloom.plans.projection import oracle, tables
from graphloom.sources import python_code as code

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, **ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql, graph=False, **ctes)
        return f

    return register


_DAY = "1998-06-01 00:00:00"
_CUT = f"TIMESTAMP '{_DAY}'"
_BEFORE, _AFTER = f"o_orderdate < TIMESTAMP_NTZ '{_DAY}'", f"o_orderdate >= TIMESTAMP_NTZ '{_DAY}'"


def _versions(spark, d):
    """Customers by their order priority and status before and after a date."""
    o = tables(spark, d)["orders"]
    part = lambda test: o.filter(test).groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderpriority").alias("value"))
    return part(_BEFORE), part(_AFTER)


_VER = {"a": f"SELECT o_custkey AS key, min(o_orderpriority) AS value FROM orders WHERE o_orderdate < {_CUT} GROUP BY o_custkey", "b": f"SELECT o_custkey AS key, min(o_orderpriority) AS value FROM orders WHERE o_orderdate >= {_CUT} GROUP BY o_custkey"}


@query("SELECT CAST(count(*) FILTER (WHERE a.key IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE b.key IS NULL) AS BIGINT) AS removed, CAST(count(*) FILTER (WHERE a.value <> b.value) AS BIGINT) AS changed, CAST(count(*) FILTER (WHERE a.value = b.value) AS BIGINT) AS kept FROM a FULL JOIN b ON a.key = b.key", **_VER)
def key_drift(spark, d):
    return scores.key_drift(*_versions(spark, d))


_ROLES = {"p": f"SELECT o_orderpriority AS role, CAST(count(*) FILTER (WHERE o_orderdate < {_CUT}) AS BIGINT) AS a, CAST(count(*) FILTER (WHERE o_orderdate >= {_CUT}) AS BIGINT) AS b FROM orders GROUP BY o_orderpriority"}


def _roles(spark, d):
    o = tables(spark, d)["orders"]
    n = lambda test: o.filter(test).groupBy(F.col("o_orderpriority").alias("role")).agg(F.count(F.lit(1)).alias("n"))
    return scores.distributions(n(_BEFORE), n(_AFTER))


@query("SELECT role, round(CASE WHEN a = 0 AND b = 0 THEN 0 WHEN a = 0 OR b = 0 THEN 0.5 ELSE abs(a - b) / CAST(greatest(a, b) AS DOUBLE) END, 9) AS drift FROM p", **_ROLES)
def count_drift(spark, d):
    return _roles(spark, d).select("role", F.round(scores.count_drift("a", "b"), 9).alias("drift"))


@query("SELECT round(1 - sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2, 9) AS similarity FROM (SELECT a / CAST(sum(a) OVER () AS DOUBLE) AS x, b / CAST(sum(b) OVER () AS DOUBLE) AS y FROM p)", **_ROLES)
def role_similarity(spark, d):
    return scores.js_similarity(_roles(spark, d)).select(F.round("similarity", 9).alias("similarity"))


@query("SELECT round(avg(least(a, b) / CAST(greatest(a, b) AS DOUBLE)), 9) AS preservation, round(sum(least(a, b)) / CAST(sum(greatest(a, b)) AS DOUBLE), 9) AS overlap FROM p WHERE a > 0 OR b > 0", **_ROLES)
def role_preservation(spark, d):
    return scores.role_preservation(_roles(spark, d)).select(F.round("preservation", 9).alias("preservation"), F.round("overlap", 9).alias("overlap"))


@query("SELECT round(1 - sum(abs(a - b)) / CAST(sum(a + b) AS DOUBLE), 9) AS similarity FROM p", **_ROLES)
def multiset_similarity(spark, d):
    return _roles(spark, d).agg(F.round(scores.multiset_similarity(), 9).alias("similarity"))


_MAT = {"m": "SELECT l_returnflag AS i, l_linenumber AS j, l_linestatus AS st, CAST(count(*) AS DOUBLE) AS p FROM lineitem GROUP BY ALL"}


@query("SELECT round(1 - sqrt(sum((coalesce(x, 0) - coalesce(y, 0)) ** 2)) / (sqrt(sum(coalesce(x, 0) ** 2)) + sqrt(sum(coalesce(y, 0) ** 2))), 6) AS similarity FROM (SELECT i, j, p AS x FROM m WHERE st = 'F') FULL JOIN (SELECT i, j, p AS y FROM m WHERE st = 'O') USING (i, j)", **_MAT)
def matrix_similarity(spark, d):
    m = tables(spark, d)["lineitem"].groupBy(F.col("l_returnflag").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_linestatus").alias("st")).agg(F.count(F.lit(1)).cast("double").alias("p"))
    return scores.matrix_similarity(m.filter("st = 'F'"), m.filter("st = 'O'"), ["i", "j"]).select(F.round("similarity", 6).alias("similarity"))


_REC = {"r": "SELECT CAST(l_partkey AS STRING) AS target_id, l_returnflag AS target_type, l_linestatus AS evidence_type, 'm' || l_linenumber AS method, l_discount / 0.7 AS confidence FROM lineitem"}


def _records(spark, d):
    return tables(spark, d)["lineitem"].select(F.col("l_partkey").cast("string").alias("target_id"), F.col("l_returnflag").alias("target_type"), F.col("l_linestatus").alias("evidence_type"), F.concat(F.lit("m"), "l_linenumber").alias("method"), (F.col("l_discount") / 0.7).alias("confidence"))


@query("SELECT target_id, round(least(1, avg(confidence) + least(0.1, 0.02 * count(DISTINCT evidence_type))), 6) AS confidence FROM r GROUP BY target_id", **_REC)
def provenance_confidence(spark, d):
    return scores.provenance_confidence(_records(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("SELECT CASE WHEN target_type IS NOT NULL THEN 'target_type' WHEN evidence_type IS NOT NULL THEN 'evidence_type' WHEN method IS NOT NULL THEN 'method' ELSE 'all' END AS dimension, coalesce(target_type, evidence_type, method) AS value, count(*) AS n, round(avg(confidence), 6) AS mean FROM r GROUP BY GROUPING SETS ((target_type), (evidence_type), (method), ())", **_REC)
def provenance_stats(spark, d):
    return scores.provenance_stats(_records(spark, d)).withColumn("mean", F.round("mean", 6))


@query("SELECT round(count(DISTINCT o_custkey) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 9) AS share FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def observability(spark, d):
    t = tables(spark, d)
    return scores.share_of(t["customer"].select(F.col("c_custkey").alias("id")), t["orders"].select(F.col("o_custkey").alias("id"))).select(F.round("share", 9).alias("share"))


@query("SELECT event_type, p AS percent, max(CASE WHEN i = least(n * p // 100, n - 1) THEN value END) AS value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) CROSS JOIN (VALUES (50), (95), (99)) v(p) GROUP BY event_type, p")
def rank_percentiles(spark, d):
    return scores.rank_percentiles(tables(spark, d)["events"], "event_type", "value", [50, 95, 99])


#: Forms of sources, as the test tables hold no code: every document gives a package of these files, with names made of its first long word and its id.
SOURCES = [
    ("shop/cart.py", "import os\nimport json as j\nfrom shop.prices import lookup\n\nLIMIT = 10\n_unused = 3\n\n\nclass Cart(Base):\n    items: list\n\n    def add(self, item, n=1):\n        if n > LIMIT and item or n < 0:\n            raise ValueError(item)\n        for _ in range(n):\n            self.items.append(item)\n        return lookup(item)\n\n    def total(self):\n        return sum(lookup(x) for x in self.items)\n\n\ndef _hidden():\n    return j.dumps({})\n"),
    ("shop/prices.py", "# prices\nTABLE = {'a': 1}\n\n\ndef lookup(name):\n    price = TABLE.get(name)\n    doubled = price * 2\n    return doubled if price else 0\n"),
    ("shop/base.py", "class Base:\n    pass\n"),
    ("shop/broken.py", "def broken(:\n"),
]


_NAMES = r"\\b(shop|Cart|add|total|_hidden|lookup|Base|TABLE|LIMIT|_unused|price|doubled|item)\\b"


def _files(spark, d):
    own = F.concat(F.lit("_"), F.coalesce(F.nullif(F.regexp_extract("text", "[a-z]{4,}", 0), F.lit("")), F.lit("none")), F.lit("_"), F.col("doc_id").cast("string"))
    # Dealt out before they are parsed: the texts of many documents lie in few parts of a file, and parsing what they give takes far longer than reading them.
    docs = tables(spark, d)["documents"].select(own.alias("own")).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "own")
    forms = F.explode(F.array(*[F.struct(F.lit(path).alias("path"), F.lit(text).alias("text")) for path, text in SOURCES])).alias("form")
    named = lambda c: F.regexp_replace(f"form.{c}", F.lit(_NAMES.replace("\\\\", "\\")), F.concat(F.lit("$1"), F.col("own"))).alias(c)
    return docs.select("own", forms).select(named("path"), named("text"))


def _code(name: str, f, *kinds: str):
    """``f`` over all facts, or over those of the only ``kinds`` that it reads."""
    QUERIES[name] = lambda spark, d: f(code.facts(_files(spark, d), kinds or None))


_code("code_facts", lambda f: f.filter("fact NOT IN ('operator', 'operand', 'use')"))
_code("code_halstead", code.halstead)
_code("code_cognitive", code.cognitive)
_code("code_dead", code.dead_code)
_code("code_hotspots", lambda f: code.hotspots(f, 3))
_code("code_entry_points", code.entry_points)
_code("code_imports", code.imports)
_code("code_calls", code.call_edges)
_code("code_flow_ends", code.flow_ends, "flow")
QUERIES["code_graph_edges"] = lambda spark, d: code.code_graph(_files(spark, d))[1]
