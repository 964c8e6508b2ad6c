"""Queries of time regimes and of types of variables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import temporal as t
from graphloom.plans.graph_queries import whole
from graphloom.plans.projection import oracle, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str, *, graph: bool = True, **ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle(sql, graph=graph, **ctes)
        return f

    return register


_A = {"renamed": "SELECT id, kind, replace(name, 'retry', 'async') AS name FROM nodes", "an": "SELECT id FROM renamed WHERE regexp_matches(lower(name), 'async|callback|promise|future')", "ev": "SELECT id FROM renamed WHERE kind = 'event' OR regexp_matches(lower(name), 'event|handler|listener|trigger')"}


def _graph(spark, d):
    g = whole(spark, d)
    return g.nodes.withColumn("name", F.expr("replace(name, 'retry', 'async')")), g.edges


@query("SELECT id FROM an", **_A)
def async_nodes(spark, d):
    return t.async_nodes(_graph(spark, d)[0])


@query("SELECT id FROM ev", **_A)
def event_nodes(spark, d):
    return t.event_nodes(_graph(spark, d)[0])


_P = "(source_id IN (SELECT id FROM an) OR target_id IN (SELECT id FROM an))"


@query(f"SELECT source_id AS predecessor, target_id AS successor, CASE WHEN {_P} THEN 'parallel' ELSE 'sequential' END AS constraint, CAST(CASE WHEN {_P} THEN 0.7 ELSE 0.95 END AS DOUBLE) AS confidence FROM edges WHERE kind IN ('calls', 'triggers')", **_A)
def temporal_orderings(spark, d):
    return t.orderings(*_graph(spark, d))


_EP = "SELECT id, CAST(sum(i) AS BIGINT) AS triggered_by, CAST(sum(o) AS BIGINT) AS handled_by FROM (SELECT target_id AS id, 1 AS i, 0 AS o FROM edges WHERE kind = 'triggers' UNION ALL SELECT source_id, 0, 1 FROM edges WHERE kind = 'triggers') WHERE id IN (SELECT id FROM ev) GROUP BY id"


@query("SELECT * FROM ep", **_A, ep=_EP)
def event_patterns(spark, d):
    return t.event_patterns(*_graph(spark, d))


@query(f"SELECT (SELECT count(*) FROM an) / CAST((SELECT count(*) FROM nodes) AS DOUBLE) AS async_fraction, (SELECT count(*) FROM ev) / CAST((SELECT count(*) FROM nodes) AS DOUBLE) AS event_fraction, CAST(count(*) FILTER (WHERE {_P}) AS BIGINT) AS parallel_edges, CAST(count(*) FILTER (WHERE NOT {_P}) AS BIGINT) AS sequential_edges, (SELECT count(*) FROM ep) AS event_patterns, CASE WHEN (SELECT count(*) FROM ep) > 0 AND (SELECT count(*) FROM an) > 0 THEN 'hybrid' WHEN (SELECT count(*) FROM ep) > 0 THEN 'event_driven' WHEN (SELECT count(*) FROM an) > 0 THEN 'asynchronous' ELSE 'synchronous' END AS regime FROM edges", **_A, ep=_EP)
def time_regime(spark, d):
    return t.regime(*_graph(spark, d))


_HINT = "CASE p_size % 8 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' WHEN 2 THEN 'real' WHEN 3 THEN 'string' WHEN 4 THEN 'list[int]' WHEN 5 THEN 'object' END"
_DESC = "CASE p_partkey % 4 WHEN 0 THEN 'Active flag' WHEN 1 THEN 'event index' WHEN 2 THEN 'log rate' END"
_TYPED = {"v": f"SELECT p_partkey AS id, {_HINT} AS h, lower(coalesce({_DESC}, '')) AS ds, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS card FROM part", "w": "SELECT *, CASE WHEN h = 'bool' THEN 'boolean' WHEN h = 'int' THEN 'discrete' WHEN h = 'real' THEN 'continuous' WHEN h = 'string' THEN 'categorical' WHEN h LIKE '%list%' THEN 'vector' WHEN h = 'object' THEN 'composite' WHEN ds LIKE '%flag%' OR ds LIKE '%active%' THEN 'boolean' WHEN ds LIKE '%index%' THEN 'discrete' WHEN ds LIKE '%rate%' THEN 'continuous' ELSE 'discrete' END AS var_type FROM v"}


def _typed(spark, d):
    p = tables(spark, d)["part"].select(F.col("p_partkey").alias("id"), F.expr(_HINT).alias("h"), F.expr(_DESC).alias("ds"), F.expr("CASE WHEN p_size % 5 > 0 THEN p_size % 5 END").alias("card"))
    return p.withColumn("var_type", t.variable_type("h", "ds"))


@query("SELECT id, var_type, CASE WHEN var_type = 'boolean' OR (var_type = 'discrete' AND coalesce(card, 0) = 2) THEN 'bernoulli' WHEN var_type IN ('discrete', 'categorical') THEN 'categorical' WHEN var_type = 'continuous' THEN 'gaussian' ELSE 'unknown' END AS distribution, CASE WHEN ds LIKE '%log%' THEN 'log' WHEN ds LIKE '%event%' THEN 'event' ELSE 'generic' END AS modality FROM w", graph=False, **_TYPED)
def variable_types(spark, d):
    return _typed(spark, d).select("id", "var_type", t.distribution("var_type", "card").alias("distribution"), t.modality_type(F.lit(""), "ds").alias("modality"))


@query("SELECT round(sum(CASE WHEN var_type <> 'continuous' AND card > 0 THEN log2(card) ELSE 0 END) + count(*) FILTER (WHERE var_type = 'continuous'), 6) AS log2_size FROM w", graph=False, **_TYPED)
def state_dimensionality(spark, d):
    return t.dimensionality(_typed(spark, d).select("var_type", F.col("card").alias("cardinality"))).select(F.round("log2_size", 6).alias("log2_size"))


_TOUCH = "SELECT DISTINCT l_suppkey AS variable, l_partkey AS target, CASE l_returnflag WHEN 'R' THEN 'writes' ELSE 'reads' END AS mode FROM lineitem"


@query("SELECT a.variable, count(DISTINCT other) AS dependencies, greatest(0, 1 - count(DISTINCT a.target) / CAST(any_value(n) AS DOUBLE)) AS independence FROM o a JOIN (SELECT variable AS other, target FROM x WHERE mode = 'writes') b ON a.target = b.target AND a.variable < other JOIN (SELECT variable, count(*) AS n FROM o GROUP BY variable) s ON s.variable = a.variable GROUP BY a.variable", graph=False, x=_TOUCH, o="SELECT DISTINCT variable, target FROM x")
def factorization(spark, d):
    x = tables(spark, d)["lineitem"].select(F.col("l_suppkey").alias("variable"), F.col("l_partkey").alias("target"), F.when(F.col("l_returnflag") == "R", "writes").otherwise("reads").alias("mode"))
    return t.factorization(x)
