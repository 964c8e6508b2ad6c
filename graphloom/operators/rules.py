"""The pattern rules that label nodes, as one plan: per-node edge counts are aggregated once and every rule is a filter on them.

``matches`` gives rule, priority, mapping_id, node_id, kind, confidence, certainty, node_ids (the fragment) and edge_ids. Rules never see each other's labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import keywords as kw
from graphloom.functions.storage import stored
from graphloom.operators.graph import PropertyGraph, edge_profile

CALLABLE = ["function", "method"]


@dataclass(frozen=True)
class Rule:
    name: str
    prefix: str
    confidence: float
    certainty: float
    priority: int = 0


# Names, prefixes and confidences of the rules, in their order of registration.
RULES = [
    Rule("read_only_input", "obs", 0.70, 0.80), Rule("mutating_subsystem", "hs", 0.75, 0.80, 1), Rule("inheritance", "inh", 0.70, 0.75), Rule("containment", "cont", 0.75, 0.80),
    Rule("data_pipeline", "dpipe", 0.75, 0.80), Rule("observation", "obs", 0.70, 0.80), Rule("action", "act", 0.80, 0.85), Rule("policy", "pol", 0.80, 0.85),
    Rule("preference", "pref", 0.85, 0.90), Rule("context", "ctx", 0.80, 0.85), Rule("config", "ctx", 0.90, 0.95), Rule("feature_flag", "fflag", 0.85, 0.90),
    Rule("parameter", "param", 0.85, 0.90), Rule("orchestrator", "orch", 0.80, 0.90), Rule("test_assertion", "const", 0.85, 0.95), Rule("event_bus", "event", 0.75, 0.80),
    Rule("state_machine", "fsm", 0.80, 0.85), Rule("retry_pattern", "policy", 0.70, 0.70), Rule("error_boundary", "errbnd", 0.70, 0.75), Rule("singleton_access", "single", 0.65, 0.70),
    Rule("circuit_breaker", "cb", 0.80, 0.85), Rule("rate_limiter", "ratelim", 0.75, 0.80),
]
BY_NAME = {r.name: r for r in RULES}


def profiled(graph: PropertyGraph) -> DataFrame:
    """Nodes with the counts of their outgoing edges by kind (0 for none) and the words of their names."""
    out = graph.nodes.join(edge_profile(graph.edges), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in out.columns if c.startswith("out_")}).withColumn("words", kw.tokens("name"))


def _targets(graph: PropertyGraph, kind: str, **more) -> DataFrame:
    """source, target columns of the edges of a kind, with the target's name and kind."""
    e = graph.edges.filter(F.col("kind") == kind).select(F.col("source_id").alias("id"), F.col("target_id").alias("t"))
    return e.join(graph.nodes.select(F.col("id").alias("t"), F.col("name").alias("t_name"), F.col("kind").alias("t_kind")), "t")


def _rows(df: DataFrame, kind: str | Column, *, fragment: Column | None = None, edges: Column | None = None, confidence: Column | None = None, certainty: Column | None = None) -> dict:
    return {"df": df, "kind": F.lit(kind) if isinstance(kind, str) else kind, "fragment": fragment, "edges": edges, "confidence": confidence, "certainty": certainty}


def _where(condition: Column, kind: str | Column, **more) -> dict:
    """A rule that looks at the profile of one node only."""
    return _rows(None, kind, **more) | {"where": condition}


def _match(name: str, graph: PropertyGraph, p: DataFrame) -> dict:
    kind, lower = F.col("kind"), F.lower("name")
    is_callable = kind.isin(CALLABLE)
    mutating = F.col("out_writes") + F.col("out_mutates")
    e = graph.edges

    if name == "read_only_input":
        return _where((kind == "module") & (F.col("out_reads") > 0) & (F.col("out_writes") == 0), "observation")
    if name == "mutating_subsystem":
        at = e.filter(F.col("kind").isin("writes", "mutates"))
        ends = at.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"), F.col("id").alias("e"))
        found = p.filter(kind == "class").join(ends, "id").groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("es"))
        return _rows(found, "hidden_state", edges=F.col("es"))
    if name == "inheritance":
        bases = _targets(graph, "inherits").groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("bases"), F.bool_or(kw.contains_any("t_name", ["handler", "controller"])).alias("acts"))
        policy = F.col("name").startswith("Abstract") | F.col("name").startswith("Base") | F.col("acts")
        return _rows(p.filter(kind == "class").join(bases, "id"), F.when(policy, "policy").otherwise("hidden_state"), fragment=F.concat(F.array("id"), "bases"))
    if name == "containment":
        hit = lambda words: F.when(kw.contains_any("t_name", words), 1).otherwise(0)
        obs, act, pol = hit(kw.OBSERVATION_KEYWORDS), hit(kw.ACTION_KEYWORDS), hit(kw.POLICY_KEYWORDS)
        # a child counts for the first vocabulary that it meets
        children = _targets(graph, "contains").groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.sum(obs).alias("o"), F.sum(F.when(obs == 0, act).otherwise(0)).alias("a"), F.sum(F.when((obs == 0) & (act == 0), pol).otherwise(0)).alias("l"))
        label = F.when((F.col("o") > F.col("a")) & (F.col("o") > F.col("l")), "observation").when((F.col("a") > F.col("o")) & (F.col("a") > F.col("l")), "action").when((F.col("l") > F.col("o")) & (F.col("l") > F.col("a")), "policy").otherwise("hidden_state")
        return _rows(p.filter((kind == "class") & (F.col("out_contains") >= 5)).join(children, "id"), label, fragment=F.concat(F.array("id"), "ts"))
    if name == "data_pipeline":
        of = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("target_id"))))
        sets = e.filter(F.col("kind").isin("reads", "writes")).groupBy(F.col("source_id").alias("id")).agg(of("reads").alias("rs"), of("writes").alias("ws"))
        found = p.filter(is_callable).join(sets, "id").filter("size(rs) > 0 AND size(ws) > 0 AND rs <> ws")
        return _rows(found, "data_flow", fragment=F.concat(F.array("id"), "rs", "ws"))
    if name == "observation":
        word = kw.token_match(F.col("words"), kw.OBSERVATION_KEYWORDS)
        return _where(is_callable & (mutating == 0) & (word | (F.col("out_reads") > 0)), "observation", confidence=F.when(word, 0.85).otherwise(0.70))
    if name == "action":
        return _where(is_callable & (kw.token_match(F.col("words"), kw.ACTION_KEYWORDS) | (mutating >= 1)), "action")
    if name == "policy":
        calls = _targets(graph, "contains").filter("t_name = '__call__'").select("id", F.lit(True).alias("callable")).distinct()
        word = kw.token_match(F.col("words"), kw.POLICY_NAMES)
        return _rows(p.join(calls, "id", "left").filter(((kind == "class") & (word | F.coalesce("callable", F.lit(False)))) | (is_callable & word)), "policy")
    if name == "preference":
        return _where(kind.isin("class", *CALLABLE) & kw.token_match(F.col("words"), kw.CONSTRAINT_NAMES), "constraint")
    if name == "context":
        word = kw.token_match(F.col("words"), kw.CONTEXT_NAMES)
        reader = (F.col("out_reads") > 0) & (F.col("out_writes") == 0) & (F.col("out_returns") > 0)
        return _where(((kind == "class") & word) | ((kind == "function") & (word | reader)), "context")
    if name == "config":
        return _where(kind == "configuration", "context")
    if name == "feature_flag":
        return _where(kind == "feature_flag", "context")
    if name == "parameter":
        named = ((kind == "variable") & kw.contains_any("name", kw.PARAMETER_NAMES)) | ((kind == "class") & kw.contains_any("name", kw.PARAMETER_CLASS_NAMES))
        return _where(named, "context", certainty=F.when(kind == "variable", 0.90).otherwise(0.85))
    if name == "orchestrator":
        callees = e.filter("kind = 'calls'").groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list("target_id")).alias("ts"))
        return _rows(p.filter(kind.isin("class", *CALLABLE) & (F.col("out_calls") >= 3)).join(callees, "id"), "orchestration", fragment=F.concat(F.array("id"), "ts"))
    if name == "test_assertion":
        return _where((kind == "function") & F.contains(lower, F.lit("test")) & (F.col("out_calls") >= 1), "constraint")
    if name == "event_bus":
        ends = e.select(F.col("source_id").alias("id")).union(e.select("target_id")).distinct()
        return _rows(p.filter(kind == "event").join(ends, "id", "left_semi"), "observation")
    if name == "state_machine":
        member = _targets(graph, "contains").filter("lower(t_name) IN ('on_enter', 'on_exit') OR (t_kind = 'variable' AND contains(lower(t_name), 'state'))").select("id", F.lit(True).alias("member")).distinct()
        return _rows(p.filter(kind == "class").join(member, "id", "left").filter(kw.contains_any("name", kw.STATE_NAMES) | F.coalesce("member", F.lit(False))), "policy")
    if name == "retry_pattern":
        return _where(is_callable & kw.contains_any("name", kw.RETRY_NAMES), "policy")
    if name == "error_boundary":
        return _where(is_callable & (F.col("out_catches") + F.col("out_throws") > 0), "error_handling")
    if name == "singleton_access":
        readers = graph.nodes.select(F.col("id").alias("source_id"), F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/", 1)).otherwise(F.col("path")).alias("dir"))
        count = e.filter("kind = 'reads'").join(readers, "source_id", "left").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dir").alias("dirs"), F.array_sort(F.collect_list("source_id")).alias("rs"))
        return _rows(p.filter(kind.isin("variable", "class")).join(count, "id").filter("n >= 3 AND dirs >= 3"), "context")
    if name == "circuit_breaker":
        text = F.concat_ws(" ", "name", F.to_json("metadata")) if "metadata" in p.columns else F.col("name")
        return _where(kind.isin("class", *CALLABLE) & (F.col("out_guards") > 0) & kw.contains_any(text, kw.CIRCUIT_NAMES), "circuit_breaker")
    if name == "rate_limiter":
        # the ids of called nodes are searched, not their names
        waits = e.filter("kind = 'calls' AND (contains(lower(target_id), 'sleep') OR contains(lower(target_id), 'backoff'))").select(F.col("source_id").alias("id"), F.lit(True).alias("waits")).distinct()
        word = kw.contains_any("name", kw.RATE_NAMES)
        return _rows(p.join(waits, "id", "left").filter((is_callable & (word | F.coalesce("waits", F.lit(False)))) | ((kind == "class") & word)), "policy")
    raise KeyError(name)


def _columns(name: str, m: dict) -> list[Column]:
    """What a match of the rule is, in columns of its rows."""
    r = BY_NAME[name]
    tag = F.substring(F.sha2(F.lit(name), 256), 1, 8)
    return [
        F.lit(name).alias("rule"), F.lit(r.priority).alias("priority"), F.concat_ws("_", F.lit(r.prefix), "id", tag).alias("mapping_id"), F.col("id").alias("node_id"), m["kind"].alias("kind"),
        (F.lit(r.confidence) if m["confidence"] is None else m["confidence"]).alias("confidence"), (F.lit(r.certainty) if m["certainty"] is None else m["certainty"]).alias("certainty"),
        (F.array("id") if m["fragment"] is None else m["fragment"]).alias("node_ids"), (F.array().cast("array<string>") if m["edges"] is None else m["edges"]).alias("edge_ids"),
    ]


def matches(graph: PropertyGraph, name: str, profile: DataFrame | None = None) -> DataFrame:
    """The matches of one rule."""
    profile = profiled(graph) if profile is None else profile
    m = _match(name, graph, profile)
    return (profile.filter(m["where"]) if "where" in m else m["df"]).select(*_columns(name, m))


def all_matches(graph: PropertyGraph, only: list[str] | None = None) -> DataFrame:
    """The matches of all rules (or those named), once for each mapping id: rules of higher priority come first, then registration order."""
    graph = PropertyGraph(stored(graph.nodes, "nodes"), stored(graph.edges, "edges"))  # each rule reads them
    profile = stored(profiled(graph), "profile")
    found = {r.name: _match(r.name, graph, profile) for r in RULES if only is None or r.name in only}
    parts = [m["df"].select(*_columns(n, m)) for n, m in found.items() if "where" not in m]
    alone = [F.when(m["where"], F.struct(*_columns(n, m))) for n, m in found.items() if "where" in m]
    if alone:  # all rules of this kind in one pass
        parts.append(profile.select(F.explode(F.array_compact(F.array(*alone))).alias("m")).select("m.*"))
    return reduce(DataFrame.unionByName, parts)


# --- rules as data: each has a node kind, a name glob, a method that the node contains and a kind of outgoing edge, all optional ---


def glob_pattern(glob: str) -> str:
    """A regular expression for ``*``, ``?`` and ``[...]``, matched against the whole name."""
    import fnmatch

    return fnmatch.translate(glob).replace("\\Z", "$").replace("(?s:", "(?s)(?:").replace("\\z", "$")


def declared_matches(graph: PropertyGraph, rules: list[dict]) -> DataFrame:
    """rule, node_id, kind, confidence of rules given as dicts: name, kind, confidence and ``when`` with node_kind, name_glob, has_method, edge_type."""
    known = {"node_kind", "name_glob", "has_method", "edge_type"}
    parts = []
    for r in rules:
        if unknown := set(r["when"]) - known:
            raise ValueError(f"unknown conditions: {sorted(unknown)}")
        w, out = r["when"], graph.nodes
        if "node_kind" in w:
            out = out.filter(F.col("kind") == w["node_kind"])
        if "name_glob" in w:
            out = out.filter(F.col("name").rlike(glob_pattern(w["name_glob"])))
        if "has_method" in w:
            out = out.join(_targets(graph, "contains").filter((F.col("t_kind") == "method") & (F.col("t_name") == w["has_method"])).select("id").distinct(), "id", "left_semi")
        if "edge_type" in w:
            out = out.join(graph.edges.filter(F.col("kind") == w["edge_type"]).select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
        parts.append(out.select(F.lit(r["name"]).alias("rule"), F.col("id").alias("node_id"), F.lit(r["kind"]).alias("kind"), F.lit(float(r.get("confidence", 0.7))).alias("confidence")))
    return reduce(DataFrame.unionByName, parts)
