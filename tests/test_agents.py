"""Agents over models of their own steps, and code facts of sources that the documents give."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.operators.inference import episode
from graphloom.plans import registry
from graphloom.sources import python_code

D = "/root/testdata/sf0.001"


def test_agents_over_the_steps_of_users(spark):
    events = sorted((r.user_id, r.ts, r.event_id, r.event_type) for r in spark.read.parquet(f"{D}/events.parquet").collect())
    states = sorted({e[3] for e in events})
    of = defaultdict(list)
    for u, _, _, t in events:
        of[u].append(t)
    want = {}
    for u, own in of.items():
        k = Counter(zip(own, own[1:]))
        if not k:
            continue
        n, total = len(states), Counter(own[:-1])
        share = [total[s] / sum(total.values()) for s in states]
        b = np.array([[[float(s == t), k[s, t] / total[s] if total[s] else 1 / n] for s in states] for t in states])
        a = [[0.9 if s == o else 0.1 / (n - 1) for s in states] for o in states]
        want[str(u)] = episode({"A": a, "B": b, "C": share, "D": share}, 8)
    got = defaultdict(list)
    for r in registry.queries()["agent_episodes"](spark, D).collect():
        got[r.agent].append((r.t, r.observation, r.action, list(r.belief), r.free_energy))
    assert set(got) == set(want) and len(got) > 10
    for u, rows in got.items():
        for x, y in zip(sorted(rows), want[u], strict=True):
            assert x[:3] == y[:3] and x[3] == pytest.approx(y[3]) and x[4] == pytest.approx(y[4])


def test_every_document_gives_a_package(spark):
    n = spark.read.parquet(f"{D}/documents.parquet").count()
    found = registry.queries()["code_facts"](spark, D)
    assert found.select("path").distinct().count() >= 3 * n
    edges = registry.queries()["code_graph_edges"](spark, D)
    assert edges.count() >= 5 * n


def test_files_are_parsed_once(spark):
    """Ends of flows and edges of code against the facts of each file; no plan parses a file twice."""
    texts = [("a/m.py", "x = y\nz = x + w\nclass A(B):\n    def f(self):\n        return g(self)\n\n\ndef g(n):\n    return A()\n"), ("a/b.py", "class B:\n    pass\n"), (None, "q = r\n"), ("bad.py", "def (:\n"), ("n.py", None)]
    files = spark.createDataFrame(texts, "path string, text string").repartition(3)
    flows = {(p, r[4], r[2]) for p, t in texts for r in python_code.facts_of(p, t) if r[1] == "flow"}
    for kinds in (None, ["flow"]):
        ends = python_code.flow_ends(python_code.facts(files, kinds))
        assert ends._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
        sources, sinks = {(p, a) for p, a, _ in flows}, {(p, b) for p, _, b in flows}
        alone = lambda x, others: x[0] is None or x not in others
        want = {(*x, "source") for x in sources if alone(x, sinks)} | {(*x, "sink") for x in sinks if alone(x, sources)}
        assert sorted(map(str, map(tuple, ends.collect()))) == sorted(map(str, want)) and len(want) == 5
    for p, t in texts:
        every = python_code.facts_of(p, t)
        for kinds in (["flow"], python_code.GRAPH_FACTS, ["operand", "metric"], ["use"], ["method", "cognitive"]):
            assert python_code.facts_of(p, t, kinds) == [r for r in every if r[1] in (*kinds, "error")]
    nodes, edges = python_code.code_graph(files.filter("path IS NOT NULL"))
    assert "MapInPandas" not in edges._jdf.queryExecution().optimizedPlan().toString()
    name = {r.id: r.name for r in nodes.collect()}
    got = sorted((name[r.source_id], name[r.target_id], r.kind) for r in edges.collect())
    assert got == [("A", "B", "inherits"), ("A", "f", "contains"), ("b", "B", "contains"), ("f", "g", "calls"), ("g", "A", "calls"), ("m", "A", "contains"), ("m", "g", "contains")]
