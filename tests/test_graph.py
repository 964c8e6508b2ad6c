import itertools
import random

import pytest

from graphloom.functions import keywords as kw
from graphloom.operators import components as c
from graphloom.operators import graph as g
from graphloom.operators import rules


def graph(spark, ids, links):
    nodes = spark.createDataFrame([(i, "function", i, i, f"{i}.py", "python") for i in ids], "id string, kind string, name string, qualified_name string, path string, language string")
    edges = spark.createDataFrame([(s + t, s, t, "calls", 1.0) for s, t in links], "id string, source_id string, target_id string, kind string, weight double")
    return g.PropertyGraph(nodes, edges)


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_degrees_and_self_loops(spark):
    x = graph(spark, "abc", [("a", "b"), ("a", "b"), ("b", "b")])
    assert {r.id: (r.in_degree, r.out_degree) for r in g.degrees(x).collect()} == {"a": (0, 2), "b": (3, 1), "c": (0, 0)}


def test_components_of_cycle_chain_and_single(spark):
    x = graph(spark, "abcdefg", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f")])
    assert as_dict(c.weak_components(x.nodes, x.edges)) == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g"}
    assert as_dict(c.strong_components(x.nodes, x.edges)) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g"}
    assert {r.id for r in c.on_cycles(x.nodes, x.edges).collect()} == {"a", "b", "c"}


def test_shortest_path_takes_smaller_ids_first(spark):
    x = graph(spark, "abcd", [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d")])
    paths = {r.id: r.path for r in c.bfs_trees(x.edges, x.nodes.filter("id = 'a'")).collect()}
    assert paths["d"] == ["a", "b", "d"] and paths["a"] == ["a"]


def test_pagerank_of_two(spark):
    x = graph(spark, "ab", [("a", "b")])
    rank = as_dict(c.pagerank(x.nodes, x.edges, iterations=2))
    assert rank == pytest.approx({"a": 0.075, "b": 0.075 + 0.85 * 0.075})


def test_merge_conflict_strategies(spark):
    a, b = graph(spark, "ab", [("a", "b")]), graph(spark, "abz", [("a", "b"), ("a", "z")])
    b = g.PropertyGraph(b.nodes, b.edges.selectExpr("id", "source_id", "target_id", "kind", "weight * 3 AS weight"))
    for strategy, weight in (("union", 3.0), ("static_priority", 1.0), ("dynamic_priority", 3.0)):
        merged, conflicts = g.merge(a, b, strategy=strategy)
        assert {(r.source_id, r.target_id): r.weight for r in merged.edges.collect()} == {("a", "b"): weight, ("a", "z"): 3.0}
        assert conflicts.count() == 1
    with pytest.raises(ValueError):
        g.merge_all([])


def test_empty_graph(spark):
    x = graph(spark, "a", [("a", "a")])
    empty = g.PropertyGraph(x.nodes.limit(0), x.edges.limit(0))
    assert g.degrees(empty).count() == 0 and c.weak_components(empty.nodes, empty.edges).count() == 0
    assert g.density(empty).first().complexity == 0


def test_tokens_and_keywords(spark):
    df = spark.createDataFrame([("get2_HTTPServerReadSensor",), ("budget",), ("sensor_temp",), ("temp_sensor",), (None,)], "name string").select("name", kw.tokens("name").alias("w"))
    rows = {r.name: r for r in df.select("name", "w", kw.token_match(df.w, kw.OBSERVATION_KEYWORDS).alias("hit")).collect()}
    assert rows["get2_HTTPServerReadSensor"].w == ["get", "2", "http", "server", "read", "sensor"]
    assert {k: r.hit for k, r in rows.items()} == {"get2_HTTPServerReadSensor": True, "budget": False, "sensor_temp": True, "temp_sensor": False, None: False}


def test_declared_rules_reject_unknown_conditions(spark):
    x = graph(spark, "ab", [("a", "b")])
    with pytest.raises(ValueError):
        rules.declared_matches(x, [{"name": "r", "kind": "policy", "when": {"colour": "red"}}])
    assert [r.node_id for r in rules.declared_matches(x, [{"name": "r", "kind": "policy", "when": {"name_glob": "[a-c]", "edge_type": "calls"}}]).collect()] == ["a"]


def test_simple_cycles_and_diameter(spark):
    x = graph(spark, "abcde", [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("c", "e"), ("a", "c"), ("c", "b")])
    found = {"".join(r.nodes): "".join(r.path) for r in c.simple_cycles(x.edges).collect()}
    assert found == {"abc": "abc", "ab": "ab", "d": "d", "ac": "ac", "bc": "bc"}
    assert c.diameter(x.nodes, x.edges) is None
    y = graph(spark, "abc", [("a", "b"), ("b", "c")])
    assert c.diameter(y.nodes, y.edges) == 2


def test_clustering_by_slices(spark):
    """Links between neighbours against brute force, in one step and in many slices, none of which sends more than its share."""
    rng = random.Random(4)
    pairs = [(f"v{rng.randrange(14)}", f"v{rng.randrange(14)}") for _ in range(60)] + [("hub", f"v{i}") for i in range(14)] + [("end", "hub")]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {v: (len(x), sum(b in near[a] for a, b in itertools.combinations(x, 2))) for v, x in near.items() if len(x) > 1}
    e = spark.createDataFrame(pairs, "source_id string, target_id string")
    for wedges in (10**8, 20):
        assert {r.id: (r.neighbours, r.links) for r in g.clustering(e, wedges=wedges).collect()} == want
