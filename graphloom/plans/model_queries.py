"""Queries of state-space parts, time lines, seeds, gaps and scores, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import blanket, components, confidence, graph, process, statespace, temporal, traces, validate
from graphloom.plans.graph_queries import _DEG, _ENDS, HALVES, halves, whole
from graphloom.plans.projection import oracle, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str, **ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle(sql, graph=ctes.pop("graph", True), **ctes)
        return f

    return register


#: Classes and variables are hidden states, observing methods observations, acting functions actions.
_MAPPINGS = """SELECT 'm:' || id AS mapping_id, CASE WHEN kind IN ('class', 'variable') THEN 'hidden_state' WHEN role = 'observation' THEN 'observation' WHEN role = 'action' THEN 'action' END AS kind,
id AS node_id, 0.3 + 0.1 * (length(name) % 8) AS score FROM nodes WHERE kind IN ('class', 'variable') OR coalesce(role, '') IN ('observation', 'action')"""


def _mappings(nodes):
    kind = F.when(F.col("kind").isin("class", "variable"), "hidden_state").when(F.col("role") == "observation", "observation").when(F.col("role") == "action", "action")
    rows = nodes.filter("kind IN ('class', 'variable') OR role IN ('observation', 'action')")
    return rows.select(F.concat(F.lit("m:"), "id").alias("mapping_id"), kind.alias("kind"), F.array("id").alias("node_ids"), (0.3 + 0.1 * (F.length("name") % 8)).alias("score"))


_LEVEL = "CASE WHEN score >= 0.95 THEN 'certain' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.4 THEN 'low' ELSE 'speculative' END"


@query(
    f"SELECT n.id, n.name, {_LEVEL} AS level, k AS cardinality, n.id IN (SELECT target_id FROM edges WHERE kind IN ('reads', 'observes')) AS observable FROM (SELECT node_id, round(score, 6) AS score FROM m WHERE kind = 'hidden_state') JOIN nodes n ON n.id = node_id LEFT JOIN (SELECT source_id, count(*) AS k FROM edges JOIN nodes ON nodes.id = target_id AND nodes.kind = 'method' WHERE edges.kind = 'contains' GROUP BY source_id) c ON c.source_id = node_id",
    m=_MAPPINGS,
)
def state_variables(spark, d):
    g = whole(spark, d)
    found = statespace.variables(_mappings(g.nodes).withColumn("score", F.round("score", 6)), g.nodes, g.edges)
    return found.select("id", "name", "level", "cardinality", "observable")


@query("SELECT 'obs:' || n.id AS id, n.name, mapping_id, round(CAST(score AS DOUBLE), 6) AS score FROM m JOIN nodes n ON n.id = node_id WHERE m.kind = 'observation'", m=_MAPPINGS)
def observation_modalities(spark, d):
    g = whole(spark, d)
    return statespace.entities(_mappings(g.nodes), g.nodes, ["observation"], last=True, prefix="obs:").select("id", "name", "mapping_id", F.round("score", 6).alias("score"))


@query(
    "SELECT DISTINCT source_id AS action, target_id AS variable, CASE WHEN edges.kind IN ('writes', 'mutates') THEN 'writes' ELSE 'reads' END AS effect FROM edges JOIN m a ON a.node_id = source_id AND a.kind = 'action' JOIN m v ON v.node_id = target_id AND v.kind = 'hidden_state' WHERE edges.kind IN ('writes', 'mutates', 'reads', 'observes')",
    m=_MAPPINGS,
)
def action_effects(spark, d):
    g = whole(spark, d)
    m = _mappings(g.nodes)
    actions = statespace.entities(m, g.nodes, ["action"], last=False)
    return statespace.action_effects(actions, statespace.variables(m, g.nodes, g.edges), g.edges)


@query("SELECT t, k, CASE WHEN t = 'boolean' OR (t = 'discrete' AND k = 2) THEN 'bernoulli' WHEN t IN ('discrete', 'categorical') THEN 'categorical' WHEN t = 'continuous' THEN 'gaussian' ELSE 'unknown' END AS distribution, count(*) AS n FROM (SELECT CASE l_partkey % 5 WHEN 0 THEN 'boolean' WHEN 1 THEN 'discrete' WHEN 2 THEN 'categorical' WHEN 3 THEN 'continuous' ELSE 'vector' END AS t, l_linenumber AS k FROM lineitem) GROUP BY t, k", graph=False)
def distribution_types(spark, d):
    rows = tables(spark, d)["lineitem"].select(F.expr("CASE l_partkey % 5 WHEN 0 THEN 'boolean' WHEN 1 THEN 'discrete' WHEN 2 THEN 'categorical' WHEN 3 THEN 'continuous' ELSE 'vector' END").alias("t"), F.col("l_linenumber").alias("k"))
    return rows.groupBy("t", "k", temporal.distribution("t", "k").alias("distribution")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, total >= (SELECT min(total) FROM (SELECT total FROM t ORDER BY total DESC LIMIT (SELECT greatest(1, count(*) // 10) FROM t))) AS hot FROM t", graph=False, t="SELECT user_id, avg(value) * count(*) AS total FROM events GROUP BY user_id")
def hot_functions(spark, d):
    times = tables(spark, d)["events"].groupBy("user_id").agg(F.avg("value").alias("mean_ms"), F.count(F.lit(1)).alias("n"))
    return traces.hot_functions(times).select("user_id", "hot")


@query("SELECT id FROM nodes WHERE id NOT IN (SELECT target_id FROM edges WHERE kind <> 'contains')")
def provenance_gaps(spark, d):
    g = whole(spark, d)
    return validate.provenance_gaps(g.nodes.select("id"), g.edges.filter("kind <> 'contains'").select("target_id"))


@query("SELECT e AS errors, w AS warnings, i AS infos, round(greatest(0, 1 - (0.1 * e + 0.02 * w + 0.001 * i) / (SELECT count(*) FROM documents)), 9) AS score FROM (SELECT count(*) FILTER (WHERE quality = 0) AS e, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS w, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS i FROM labels)", graph=False)
def validation_score(spark, d):
    t = tables(spark, d)
    issues = t["labels"].select(F.expr("CASE WHEN quality = 0 THEN 'error' WHEN toxic = 1 THEN 'warning' ELSE 'info' END").alias("severity"))
    return validate.validation_score(issues, t["documents"].count()).withColumn("score", F.round(F.col("score").cast("double"), 9))


@query("SELECT 'm:' || id AS mapping_id FROM nodes WHERE (kind IN ('class', 'variable') OR coalesce(role, '') IN ('observation', 'action')) AND 3 + length(name) % 8 >= 7")
def confident_mappings(spark, d):
    return confidence.confident(_mappings(whole(spark, d).nodes).withColumn("score", F.round("score", 6)), 0.7).select("mapping_id")


@query("SELECT id FROM c", c="SELECT id FROM nodes WHERE kind = 'module' AND (contains(name, 'asia') OR contains(name, 'euro')) UNION SELECT target_id FROM edges JOIN c ON source_id = c.id WHERE kind = 'contains'")
def module_seeds(spark, d):
    g = whole(spark, d)
    return blanket.module_seeds(g.nodes, g.edges, ["asia", "euro"])


@query("SELECT id, degree AS score FROM f ORDER BY degree DESC, id LIMIT (SELECT greatest(1, count(*) // 4) FROM f)", ends=_ENDS, deg=_DEG, f="SELECT id, degree FROM deg WHERE id IN (SELECT id FROM nodes WHERE kind = 'function')")
def interface_nodes(spark, d):
    g = whole(spark, d)
    degrees = graph.degrees(g).join(g.nodes.filter("kind = 'function'").select("id"), "id")
    return temporal.interface_nodes(degrees.select("id", F.col("degree").alias("score")))


_STAGES = {
    "l": "SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE kind IN ('contains', 'inherits') AND target_id LIKE 'n:%'",
    "s": "SELECT id AS stage, CAST(1 + length(name) % 3 AS DOUBLE) AS duration FROM nodes WHERE kind IN ('module', 'class')",
    "p": "SELECT stage, CAST(0 AS DOUBLE) AS begins FROM s WHERE stage NOT IN (SELECT b FROM l) UNION ALL SELECT b, begins + duration FROM p JOIN l ON a = p.stage JOIN s ON s.stage = p.stage",
}


def _timeline(spark, d):
    g = whole(spark, d)
    links = g.edges.filter("kind IN ('contains', 'inherits') AND target_id LIKE 'n:%'").select(F.col("source_id").alias("source_stage"), F.col("target_id").alias("target_stage"))
    return process.timeline(g.nodes.filter("kind IN ('module', 'class')").select(F.col("id").alias("stage"), (1 + F.length("name") % 3).cast("double").alias("duration")), links)


@query('SELECT p.stage, max(begins) AS start, max(begins) + any_value(duration) AS "end" FROM p JOIN s ON s.stage = p.stage GROUP BY p.stage', **_STAGES)
def process_timeline(spark, d):
    return _timeline(spark, d)


@query('SELECT * FROM t WHERE start < 3 AND "end" > 1', **_STAGES, t='SELECT p.stage, max(begins) AS start, max(begins) + any_value(duration) AS "end" FROM p JOIN s ON s.stage = p.stage GROUP BY p.stage')
def stages_in_range(spark, d):
    return temporal.in_range(_timeline(spark, d), 1.0, 3.0)


@query("SELECT max(begins + duration) AS total FROM p JOIN s ON s.stage = p.stage", **_STAGES)
def total_duration(spark, d):
    return process.total_duration(_timeline(spark, d))


@query(
    "SELECT id FROM n WHERE id NOT IN (SELECT id FROM r)",
    n="SELECT * FROM nodes WHERE kind <> 'module'",
    e="SELECT * FROM edges WHERE kind IN ('contains', 'throws', 'returns') AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)",
    r="SELECT id FROM n WHERE id NOT IN (SELECT target_id FROM e) UNION SELECT target_id FROM r JOIN e ON source_id = r.id",
)
def unreachable_nodes(spark, d):
    g = whole(spark, d)
    some = graph.PropertyGraph(g.nodes, g.edges.filter("kind IN ('contains', 'throws', 'returns')"))
    g = graph.induced(some, some.nodes.filter("kind <> 'module'"))
    return components.unreachable(g.nodes, g.edges)


@query(
    "SELECT i.path, module, arg_max(n.qualified_name, length(n.qualified_name)) AS target FROM i JOIN nodes n ON n.kind IN ('module', 'class') AND n.qualified_name <> importer AND starts_with(module || '.', n.qualified_name || '.') GROUP BY i.path, module",
    i="SELECT id AS path, replace(path, '/', '.') || '.' || name AS module, lower(name) AS importer FROM nodes WHERE kind IN ('function', 'method', 'variable') UNION ALL SELECT id, qualified_name, qualified_name FROM nodes WHERE kind = 'class'",
)
def import_targets(spark, d):
    n = whole(spark, d).nodes
    i = n.filter("kind IN ('function', 'method', 'variable')").selectExpr("id AS path", "replace(path, '/', '.') || '.' || name AS module", "lower(name) AS importer")
    i = i.union(n.filter("kind = 'class'").select("id", "qualified_name", "qualified_name"))
    return graph.resolve_imports(i, n.filter("kind IN ('module', 'class')").select(F.col("qualified_name").alias("name")))


@query(
    "SELECT 'node' AS what, coalesce(a.id, b.id) AS key, coalesce(a.name, b.name) || '|' || coalesce(upper(b.name), a.name) || '|' || CASE WHEN a.id IS NULL THEN '' ELSE a.kind END AS value, NULL AS weight FROM na a FULL JOIN nb b ON a.id = b.id "
    "UNION ALL SELECT 'edge', source_id || '|' || target_id || '|' || kind, '', round(greatest(coalesce(a.weight, b.weight), coalesce(b.weight, a.weight)), 6) FROM ea a FULL JOIN eb b USING (source_id, target_id, kind) "
    "WHERE source_id IN (SELECT id FROM na UNION SELECT id FROM nb) AND target_id IN (SELECT id FROM na UNION SELECT id FROM nb)",
    **HALVES,
)
def incremental_merge(spark, d):
    a, b = halves(spark, d)
    a = graph.PropertyGraph(a.nodes.withColumn("metadata", F.create_map(F.lit("name"), "name", F.lit("kind"), "kind")), a.edges)
    b = graph.PropertyGraph(b.nodes.withColumn("metadata", F.create_map(F.lit("name"), F.upper("name"))), b.edges)
    g = graph.incremental_merge(a, b)
    value = F.concat("name", F.lit("|"), F.col("metadata")["name"], F.lit("|"), F.coalesce(F.col("metadata")["kind"], F.lit("")))
    nodes = g.nodes.select(F.lit("node").alias("what"), F.col("id").alias("key"), value.alias("value"), F.lit(None).cast("double").alias("weight"))
    return nodes.union(g.edges.select(F.lit("edge"), F.concat_ws("|", "source_id", "target_id", "kind"), F.lit(""), F.round("weight", 6)))
