"""Queries of the rule engine and of confidence, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import keywords as kw
from graphloom.functions.storage import stored
from graphloom.operators import confidence as c
from graphloom.operators import rules
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.graph_queries import whole
from graphloom.plans.projection import documents_labels, nodes, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_KINDS = ["reads", "writes", "mutates", "returns", "calls", "contains", "throws", "catches", "guards"]
_TOKENS = "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'), '([0-9])([A-Za-z])', '\\1_\\2', 'g')), '_'), lambda x: x <> '')"
PROFILE = {
    "pr": "SELECT source_id AS id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in _KINDS) + " FROM edges GROUP BY source_id",
    "p": f"SELECT nodes.*, {_TOKENS} AS words, " + ", ".join(f"coalesce({k}, 0) AS {k}" for k in _KINDS) + " FROM nodes LEFT JOIN pr USING (id)",
    "t": "SELECT source_id AS id, target_id AS t, e.kind AS ek, n.name AS t_name, n.kind AS t_kind FROM edges e JOIN nodes n ON n.id = target_id",
}


def _match(words: list[str]) -> str:
    bare, lead = [k for k in words if not k.endswith("_")], [k[:-1] for k in words if k.endswith("_")]
    return f"(list_has_any(words, {bare}) OR coalesce(words[1] IN ({', '.join(map(repr, lead or ['']))}), false))"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


_CALLABLE = "kind IN ('function', 'method')"
_MUT = "(writes + mutates)"
#: For each rule: what its oracle selects after SELECT (id, kind, confidence, size of the fragment), FROM p.
_SQL = {
    "read_only_input": "id, 'observation', 0.7, 1 FROM p WHERE kind = 'module' AND reads > 0 AND writes = 0",
    "mutating_subsystem": "id, 'hidden_state', 0.75, 1 FROM p WHERE kind = 'class' AND id IN (SELECT source_id FROM edges WHERE kind IN ('writes', 'mutates') UNION SELECT target_id FROM edges WHERE kind IN ('writes', 'mutates'))",
    "inheritance": "p.id, CASE WHEN name LIKE 'Abstract%' OR name LIKE 'Base%' OR bool_or(contains(lower(t_name), 'handler') OR contains(lower(t_name), 'controller')) THEN 'policy' ELSE 'hidden_state' END, 0.7, 1 + count(*) FROM p JOIN t ON t.id = p.id AND ek = 'inherits' WHERE kind = 'class' GROUP BY p.id, name",
    "containment": f"id, CASE WHEN o > a AND o > l THEN 'observation' WHEN a > o AND a > l THEN 'action' WHEN l > o AND l > a THEN 'policy' ELSE 'hidden_state' END, 0.75, n + 1 FROM (SELECT p.id, count(*) AS n, count(*) FILTER (WHERE {_any('t_name', kw.OBSERVATION_KEYWORDS)}) AS o, count(*) FILTER (WHERE NOT {_any('t_name', kw.OBSERVATION_KEYWORDS)} AND {_any('t_name', kw.ACTION_KEYWORDS)}) AS a, count(*) FILTER (WHERE NOT {_any('t_name', kw.OBSERVATION_KEYWORDS)} AND NOT {_any('t_name', kw.ACTION_KEYWORDS)} AND {_any('t_name', kw.POLICY_KEYWORDS)}) AS l FROM p JOIN t ON t.id = p.id AND ek = 'contains' WHERE kind = 'class' AND contains >= 5 GROUP BY p.id)",
    "data_pipeline": f"id, 'data_flow', 0.75, 1 + len(rs) + len(ws) FROM (SELECT p.id, list_sort(list(DISTINCT t) FILTER (WHERE ek = 'reads')) AS rs, list_sort(list(DISTINCT t) FILTER (WHERE ek = 'writes')) AS ws FROM p JOIN t ON t.id = p.id WHERE {_CALLABLE} AND ek IN ('reads', 'writes') GROUP BY p.id) WHERE len(rs) > 0 AND len(ws) > 0 AND rs <> ws",
    "observation": f"id, 'observation', CASE WHEN {_match(kw.OBSERVATION_KEYWORDS)} THEN 0.85 ELSE 0.7 END, 1 FROM p WHERE {_CALLABLE} AND {_MUT} = 0 AND ({_match(kw.OBSERVATION_KEYWORDS)} OR reads > 0)",
    "action": f"id, 'action', 0.8, 1 FROM p WHERE {_CALLABLE} AND ({_match(kw.ACTION_KEYWORDS)} OR {_MUT} >= 1)",
    "policy": f"id, 'policy', 0.8, 1 FROM p WHERE kind IN ('class', 'function', 'method') AND {_match(kw.POLICY_NAMES)}",
    "preference": f"id, 'constraint', 0.85, 1 FROM p WHERE kind IN ('class', 'function', 'method') AND {_match(kw.CONSTRAINT_NAMES)}",
    "context": f"id, 'context', 0.8, 1 FROM p WHERE (kind = 'class' AND {_match(kw.CONTEXT_NAMES)}) OR (kind = 'function' AND ({_match(kw.CONTEXT_NAMES)} OR (reads > 0 AND writes = 0 AND returns > 0)))",
    "config": "id, 'context', 0.9, 1 FROM p WHERE kind = 'configuration'",
    "feature_flag": "id, 'context', 0.85, 1 FROM p WHERE kind = 'feature_flag'",
    "parameter": f"id, 'context', 0.85, 1 FROM p WHERE (kind = 'variable' AND {_any('name', kw.PARAMETER_NAMES)}) OR (kind = 'class' AND {_any('name', kw.PARAMETER_CLASS_NAMES)})",
    "orchestrator": "id, 'orchestration', 0.8, 1 + calls FROM p WHERE kind IN ('class', 'function', 'method') AND calls >= 3",
    "test_assertion": "id, 'constraint', 0.85, 1 FROM p WHERE kind = 'function' AND contains(lower(name), 'test') AND calls >= 1",
    "event_bus": "id, 'observation', 0.75, 1 FROM p WHERE kind = 'event' AND id IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)",
    "state_machine": f"id, 'policy', 0.8, 1 FROM p WHERE kind = 'class' AND ({_any('name', kw.STATE_NAMES)} OR id IN (SELECT id FROM t WHERE ek = 'contains' AND (lower(t_name) IN ('on_enter', 'on_exit') OR (t_kind = 'variable' AND contains(lower(t_name), 'state')))))",
    "retry_pattern": f"id, 'policy', 0.7, 1 FROM p WHERE {_CALLABLE} AND {_any('name', kw.RETRY_NAMES)}",
    "error_boundary": f"id, 'error_handling', 0.7, 1 FROM p WHERE {_CALLABLE} AND catches + throws > 0",
    "singleton_access": "id, 'context', 0.65, 1 FROM p WHERE kind IN ('variable', 'class') AND id IN (SELECT target_id FROM edges e JOIN nodes r ON r.id = source_id WHERE e.kind = 'reads' GROUP BY target_id HAVING count(*) >= 3 AND count(DISTINCT CASE WHEN contains(r.path, '/') THEN regexp_extract(r.path, '^(.*)/', 1) ELSE r.path END) >= 3)",
    "circuit_breaker": f"id, 'circuit_breaker', 0.8, 1 FROM p WHERE kind IN ('class', 'function', 'method') AND guards > 0 AND {_any('name', kw.CIRCUIT_NAMES)}",
    "rate_limiter": f"id, 'policy', 0.75, 1 FROM p WHERE (({_CALLABLE}) OR kind = 'class') AND {_any('name', kw.RATE_NAMES)}",
}


#: The projection has no such kinds: for the rules on them, variables of two names are taken as configurations and flags.
_FLAGS = "CASE WHEN kind = 'variable' AND name LIKE 'lambda%' THEN 'configuration' WHEN kind = 'variable' AND name LIKE 'alpha%' THEN 'feature_flag' ELSE kind END"


def _rule(name: str):
    prefix, flags = rules.BY_NAME[name].prefix, name in ("config", "feature_flag")

    def run(spark, d):
        graph = whole(spark, d)
        if flags:
            graph = PropertyGraph(graph.nodes.withColumn("kind", F.expr(_FLAGS)), graph.edges)
        return rules.matches(graph, name).select("mapping_id", "node_id", "kind", "confidence", F.size("node_ids").cast("long").alias("fragment"))

    QUERIES[f"rule_{name}"] = run
    ORACLE[f"rule_{name}"] = oracle(f"SELECT '{prefix}_' || id || '_' || substr(sha256('{name}'), 1, 8) AS mapping_id, id AS node_id, k AS kind, CAST(c AS DOUBLE) AS confidence, CAST(f AS BIGINT) AS fragment FROM (SELECT {_SQL[name]}) AS x(id, k, c, f)", **(PROFILE | {"p": PROFILE["p"].replace("nodes.*", f"nodes.* REPLACE ({_FLAGS} AS kind)")} if flags else PROFILE))


for _name in _SQL:
    _rule(_name)


def query(sql: str | None = None, *, graph: bool = True, **ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql, graph=graph, **ctes)
        return f

    return register


_ALL = " UNION ALL ".join(f"SELECT '{n}' AS rule, {rules.BY_NAME[n].certainty} AS cert, x.* FROM (SELECT {s}) AS x(id, kind, conf, f)" for n, s in _SQL.items())
SCORED = {**PROFILE, "m": _ALL, "s": "SELECT rule, id, kind, CASE WHEN rule = 'parameter' THEN least(1, (conf + 0.1) * (SELECT CASE WHEN nodes.kind = 'variable' THEN 0.9 ELSE 0.85 END FROM nodes WHERE nodes.id = m.id)) ELSE least(1, (conf + 0.1) * cert) END AS score FROM m"}


def _translated(spark, d):
    return c.scored(c.with_static_evidence(rules.all_matches(whole(spark, d))))


@query("SELECT rule, kind, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_score, CAST(count(*) FILTER (WHERE score >= 0.7) AS BIGINT) AS high FROM s GROUP BY rule, kind", **SCORED)
def translate_scored(spark, d):
    return _translated(spark, d).groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("score") >= 0.7).alias("high"))


@query("SELECT kind, CAST(NULL AS STRING) AS tier, CAST(count(*) AS BIGINT) AS count, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS greatest FROM s GROUP BY kind UNION ALL SELECT kind, 'static_only', count(*), round(avg(score), 6), round(min(score), 6), round(max(score), 6) FROM s GROUP BY GROUPING SETS ((kind), ()) UNION ALL SELECT NULL, NULL, count(*), round(avg(score), 6), round(min(score), 6), round(max(score), 6) FROM s", **SCORED)
def scoring_report(spark, d):
    out = c.report(_translated(spark, d))
    return out.select("kind", "tier", "count", *[F.round(x, 6).alias(x) for x in ("mean", "least", "greatest")])


@query("SELECT CAST(count(DISTINCT id) AS BIGINT) AS mapped_nodes, (SELECT count(*) FROM nodes) AS total_nodes, round(100.0 * count(DISTINCT id) / (SELECT count(*) FROM nodes), 2) AS percent FROM (SELECT id FROM m WHERE rule <> 'none' UNION SELECT t.t FROM m JOIN t ON t.id = m.id WHERE (rule = 'inheritance' AND ek = 'inherits') OR (rule = 'containment' AND ek = 'contains') OR (rule = 'data_pipeline' AND ek IN ('reads', 'writes')) OR (rule = 'orchestrator' AND ek = 'calls'))", **SCORED)
def mapping_coverage(spark, d):
    graph = whole(spark, d)
    return c.coverage(rules.all_matches(graph), graph.nodes)


_SINGLE = ["observation", "action", "policy", "preference", "context", "retry_pattern", "rate_limiter", "test_assertion", "error_boundary"]


@query()
def resolve_conflicts(spark, d):
    m = stored(rules.all_matches(whole(spark, d), _SINGLE), "matches")
    return c.resolved(m).select("mapping_id", "node_id", "rule", "kind", "confidence")


@query("SELECT 'entry' AS rule, id AS node_id, 'policy' AS kind, CAST(0.9 AS DOUBLE) AS confidence FROM nodes WHERE kind = 'function' AND regexp_matches(name, '^(?:get|route)_.*[0-4]$') AND id IN (SELECT source_id FROM edges WHERE kind = 'calls') UNION ALL SELECT 'base', id, 'hidden_state', CAST(0.7 AS DOUBLE) FROM nodes WHERE kind = 'class' AND name LIKE 'Base%'")
def declared_rules(spark, d):
    when = lambda g: {"node_kind": "function", "name_glob": g, "edge_type": "calls"}
    return rules.declared_matches(whole(spark, d), [
        {"name": "entry", "kind": "policy", "confidence": 0.9, "when": when("get_*[0-4]")}, {"name": "entry", "kind": "policy", "confidence": 0.9, "when": when("route_*[0-4]")},
        {"name": "base", "kind": "hidden_state", "when": {"node_kind": "class", "name_glob": "Base*"}},
    ])


def _evidenced(spark, d):
    """One mapping for each labelled document: evidence of several sources and confidences by its labels and length."""
    rows = documents_labels(spark, d)
    record = lambda s, x: F.struct(F.lit(s).alias("source"), x.cast("double").alias("confidence"))
    p = F.array_compact(F.array(record("static_analysis", 0.6 + 0.3 * F.col("quality")), F.when(F.col("doc_id") % 2 == 0, record("dynamic_trace", 0.503 + 0.01 * (F.col("n_chars") % 50))), F.when(F.col("toxic") == 1, record("human_review", F.lit(0.95)))))
    return rows.select(F.col("doc_id").cast("string").alias("mapping_id"), F.col("lang").alias("kind"), p.alias("provenance"), F.lit(0.9).alias("certainty"))


_EVID = {
    "dl": "SELECT doc_id, lang, n_chars, max(quality) AS quality, max(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY doc_id, lang, n_chars",
    "v": "SELECT CAST(doc_id AS STRING) AS mapping_id, 0.6 + 0.3 * quality AS st, CASE WHEN doc_id % 2 = 0 THEN 0.503 + 0.01 * (n_chars % 50) END AS dy, CASE WHEN toxic = 1 THEN 0.95 END AS hu FROM dl",
    "w": "SELECT *, 1 + (dy IS NOT NULL)::INT + (hu IS NOT NULL)::INT AS n, greatest(st, coalesce(dy, st), coalesce(hu, st)) - least(st, coalesce(dy, st), coalesce(hu, st)) AS spread FROM v",
    "y": "SELECT *, CASE WHEN n >= 2 AND spread > 0.3 THEN 0.1 ELSE 0 END + CASE WHEN abs(st - dy) > 0.25 THEN 0.15 ELSE 0 END AS pen FROM w",
    "z": "SELECT mapping_id, n, pen, greatest(0, least(1, ((st + coalesce(dy, 0) + coalesce(hu, 0)) / n + 0.1) * 0.9 - 0.05 * pen)) AS score, hu, dy FROM y",
}


@query("SELECT mapping_id, CAST(n AS INT) AS evidence_count, CAST(1 AS DOUBLE) AS diversity, round(score, 6) AS score, CASE WHEN hu IS NOT NULL THEN 'human_reviewed' WHEN dy IS NOT NULL AND score >= 0.65 THEN 'static_plus_runtime' ELSE 'static_only' END AS tier, round(pen, 6) AS penalty FROM z", graph=False, **_EVID)
def confidence_model(spark, d):
    out = c.scored(_evidenced(spark, d))
    return out.select("mapping_id", "evidence_count", "diversity", F.round("score", 6).alias("score"), "tier", F.round(F.aggregate("penalties", F.lit(0.0), lambda a, x: a + x), 6).alias("penalty"))


@query(
    "SELECT lang AS rule, CAST(sum(a) AS BIGINT) AS accepted, CAST(sum(r) AS BIGINT) AS rejected, count(*) AS total, CASE WHEN sum(a) + sum(r) > 0 THEN sum(a) / CAST(sum(a) + sum(r) AS DOUBLE) END AS precision, (sum(a) + sum(r)) / CAST(count(*) AS DOUBLE) AS review_coverage FROM (SELECT lang, (quality = 1 AND doc_id % 3 = 0)::INT AS a, (quality = 0)::INT AS r FROM dl) GROUP BY lang",
    graph=False, dl=_EVID["dl"],
)
def review_calibration(spark, d):
    decisions = documents_labels(spark, d).select(F.col("doc_id").cast("string").alias("mapping_id"), F.expr("CASE WHEN quality = 0 THEN 'reject' WHEN doc_id % 3 = 0 THEN 'accept' END").alias("decision"), F.lit(None).cast("string").alias("label"))
    return c.calibration(c.reviewed(c.scored(_evidenced(spark, d)).withColumn("rule", F.col("kind")), decisions))


@query(f"SELECT id, array_to_string({_TOKENS}, ' ') AS words FROM nodes")
def name_tokens(spark, d):
    return nodes(spark, d).select("id", F.array_join(kw.tokens("name"), " ").alias("words"))


_TIER = "CASE WHEN hu IS NOT NULL THEN 'human_reviewed' WHEN dy IS NOT NULL AND score >= 0.65 THEN 'static_plus_runtime' ELSE 'static_only' END"


@query(f"SELECT mapping_id, {_TIER} AS tier FROM z WHERE round(score, 9) < 0.7", graph=False, **_EVID)
def low_confidence(spark, d):
    scored = c.scored(_evidenced(spark, d)).withColumn("score", F.round("score", 9))
    return c.low_confidence(scored, 0.7).select("mapping_id", "tier")


@query("SELECT mapping_id, round(CAST(pen AS DOUBLE), 6) AS penalty FROM z WHERE pen > 0", graph=False, **_EVID)
def conflicted_mappings(spark, d):
    return c.conflicted(c.scored(_evidenced(spark, d))).select("mapping_id", F.round(F.aggregate("penalties", F.lit(0.0), lambda a, x: a + x), 6).alias("penalty"))


@query(f"SELECT mapping_id FROM z WHERE {_TIER} = 'static_plus_runtime'", graph=False, **_EVID)
def mappings_by_tier(spark, d):
    return c.by_tier(c.scored(_evidenced(spark, d)), "static_plus_runtime").select("mapping_id")


@query("SELECT CAST(doc_id AS STRING) AS mapping_id FROM dl WHERE lang = 'de'", graph=False, dl=_EVID["dl"])
def mappings_by_kind(spark, d):
    return c.by_kind(_evidenced(spark, d), "de").select("mapping_id")
