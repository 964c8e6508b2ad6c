import json
import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import blanket, confidence, inference, process, statespace, traces
from graphloom.operators.graph import PropertyGraph
from graphloom.sources import files, python_code, sinks
from graphloom.streaming import trace_stream


def test_chrome_trace_nesting(spark, tmp_path):
    events = [{"name": "outer", "ph": "B", "ts": 100}, {"name": "inner", "ph": "B", "ts": 200}, {"name": "x", "ph": "X", "ts": 210, "dur": 40}, {"name": "inner", "ph": "E", "ts": 300}, {"name": "outer", "ph": "E", "ts": 400}, {"name": "lost", "ph": "E", "ts": 500}]
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"traceEvents": events}))
    e = traces.chrome_events(files.chrome_trace(spark, str(path)))
    assert {(r.caller, r.callee): r.n for r in traces.call_graph(e).collect()} == {("outer", "inner"): 1, ("inner", "x"): 1}
    assert {r.name: r.mean_ms for r in traces.timing(e).collect()} == pytest.approx({"outer": 0.3, "inner": 0.1, "x": 0.04})
    assert traces.call_sequences(e).first().calls == ["outer", "inner", "x"]


def test_coverage_sources(spark, tmp_path):
    path = tmp_path / "c.xml"
    path.write_text('<coverage><packages><package><classes><class filename="main.py"><lines><line number="1" hits="1"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert sorted((r.file, r.line, r.hits) for r in files.cobertura(spark, str(path)).collect()) == [("main.py", 1, 1), ("main.py", 2, 0)]
    bits = spark.createDataFrame([("a.py", bytearray([0b00000110, 0b1]))], "file string, numbits binary")
    assert sorted(r.line for r in files.coverage_lines(bits).collect()) == [1, 2, 8]


def test_manifests_stacks_and_changes(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# c\n\nnumpy>=1.0\n-e ./here\npandas\n")
    assert [(r.name, r.version, r.is_local) for r in files.requirements(spark, str(tmp_path / "r.txt")).collect()] == [("numpy", ">=1.0", False), ("./here", None, True), ("pandas", "", False)]
    (tmp_path / "package.json").write_text('{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}')
    assert sorted((r.name, r.is_dev) for r in files.package_json(spark, str(tmp_path / "package.json")).collect()) == [("a", False), ("b", True)]
    (tmp_path / "f.txt").write_text("a;b;c 3\nd 1\n")
    assert sorted((r.leaf, r.n) for r in files.folded_stacks(spark, str(tmp_path / "f.txt")).collect()) == [("c", 3), ("d", 1)]
    changes = files.changed_files(spark.createDataFrame([("M\ta.py",), ("R100\told.py\tnew.py",), ("D\tc.py",)], "value string"))
    assert sorted((r.change, r.path) for r in changes.collect()) == [("D", "c.py"), ("M", "a.py"), ("R", "new.py")]
    cached = spark.createDataFrame([("a.py", 1), ("b.py", 1), ("c.py", 1)], "path string, v int")
    assert sorted(map(tuple, files.patched(cached, spark.createDataFrame([("a.py", 2)], "path string, v int"), changes).collect())) == [("a.py", 2), ("b.py", 1)]


def test_python_facts():
    rows = python_code.facts_of("m.py", "def f(a):\n    if a and a > 1:\n        return g(a)\n    return 0\n")
    assert ("m.py", "function", "f", None, "a", 1, 3.0) in rows
    assert any(r[1:4] == ("call", "g", "f") for r in rows)
    assert python_code.facts_of("b.py", "def (")[0][1] == "error"


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "class", 'A "x" <&>')], "id string, kind string, name string")
    edges = spark.createDataFrame([("a", "a", "calls", 1.0)], "source_id string, target_id string, kind string, weight double")
    x = PropertyGraph(nodes, edges)
    import xml.dom.minidom as dom

    doc = dom.parseString("".join(r.line for r in sinks.graphml_rows(x).orderBy("part").collect()))
    assert len(doc.getElementsByTagName("node")) == 1 and doc.getElementsByTagName("data")[0].firstChild.data == 'A "x" <&>'
    assert [r.line for r in sinks.dot_lines(x).orderBy("part").collect()][0] == "digraph G {"
    assert sinks.mermaid_lines(x).count() == 3
    sinks.write_parquet(x, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "edges.parquet")).count() == 1
    sinks.write_arrow(nodes, str(tmp_path / "n.arrow"))
    assert (tmp_path / "n.arrow").stat().st_size > 0


def test_conflicts_are_greedy_in_order_of_ids(spark):
    m = spark.createDataFrame([("a", 0, 0.5, ["1", "2"]), ("b", 0, 0.7, ["2", "3"]), ("c", 0, 0.7, ["3"]), ("d", 1, 0.1, ["9"])], "mapping_id string, priority int, confidence double, node_ids array<string>")
    assert sorted(r.mapping_id for r in confidence.resolved(m).collect()) == ["b", "d"]


def test_blanket_roles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("d", "c"), ("a", "a")], "source_id string, target_id string")
    assert {r.id: r.role for r in blanket.partition(nodes, edges, nodes.filter("id <> 'd'")).collect()} == {"a": "internal", "b": "active", "c": "sensory", "d": "external"}


def test_timeline_and_levels(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")], "source_stage string, target_stage string")
    level = {r.stage: r.level for r in process.levels(links).collect()}
    assert level == {"a": 0, "b": 1, "c": 1, "d": 2, "x": None, "y": None}
    t = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 2.0), ("d", 1.0)], "stage string, duration double")
    assert {r.stage: (r.start, r.end) for r in process.timeline(t, links).collect()} == {"a": (0.0, 1.0), "b": (1.0, 6.0), "c": (1.0, 3.0), "d": (6.0, 7.0)}


def test_matrices_are_stochastic(spark):
    s, o, a = (spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("s", "xyz"), ("o", "pq"), ("a", "kl")))
    m = statespace.matrix_a(o, s, spark.createDataFrame([("p", "x")], "o string, s string"))
    assert statespace.violations(m, ["s"]).count() == 0
    b = statespace.matrix_b(s, a, spark.createDataFrame([("k", "x")], "a string, s string"))
    assert statespace.violations(b, ["s", "a"]).count() == 0
    assert b.filter("a = 'l' AND s = s_next AND p = 1").count() == 3


def test_agents_learn_and_stop():
    trail = inference.episode(inference.demo_model(), 50, threshold=1e-9)
    assert len(trail) < 50 and trail[-1][3][0] > 0.99
    learnt = inference.learn(inference.demo_model(), 3, 5)
    assert all(math.isclose(sum(row[s] for row in learnt["A"]), 1) for s in range(2))


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [(i, f"f{i % 2}", i * 100, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, name string, dur long, tid long").withColumn("ts", F.expr("timestamp_seconds(seq * 60)"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = trace_stream.windowed_timing(stream).writeStream.outputMode("complete").format("memory").queryName("timing").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT start, name, n, total FROM timing").collect()))
    batch = df.groupBy(F.window("ts", "5 minutes").start.alias("start"), "name").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("total"))
    assert got == sorted(map(tuple, batch.select("start", "name", "n", "total").collect()))


def test_policies_by_expected_free_energy(spark):
    model = inference.demo_model()
    assert inference.expected_free_energy(model, [1.0, 0.0], [0]) < inference.expected_free_energy(model, [1.0, 0.0], [1])
    p = spark.createDataFrame([("stay", [0, 0]), ("go", [1, 0])], "policy string, actions array<int>")
    assert {r.policy for r in inference.ranked_policies(p, model, [1.0, 0.0]).orderBy("efe").limit(1).collect()} == {"stay"}


def test_review_splits_and_merges(spark):
    m = spark.createDataFrame([("map00001x", "policy", ["1", "2"]), ("map00002y", "action", ["2", "3"])], "mapping_id string, kind string, node_ids array<string>")
    parts = spark.createDataFrame([("map00001x", [("action", ["1"]), ("policy", ["2"])])], "mapping_id string, pieces array<struct<kind: string, node_ids: array<string>>>")
    assert sorted(r.mapping_id for r in confidence.split(m, parts).collect()) == ["map00001x_split_0", "map00001x_split_1", "map00002y"]
    merged = confidence.joined(m, spark.createDataFrame([("map00001x", 1), ("map00002y", 1)], "mapping_id string, grp int")).first()
    assert (merged.mapping_id, merged.kind, merged.node_ids) == ("merged_map00001_map00002", "policy", ["1", "2", "3"])


def test_cognitive_complexity_counts_nesting():
    import ast

    from graphloom.sources.python_code import nesting_cost

    cost = lambda text: nesting_cost(ast.parse(text).body)
    assert cost("x = 1") == 0 and cost("if a:\n  pass\nelse:\n  pass") == 1
    assert cost("if a:\n  for b in c:\n    while d:\n      pass") == 1 + 1 + 2
    assert cost("try:\n  if a: pass\nexcept E:\n  if b:\n    with c:\n      pass\nfinally:\n  pass") == 1 + 1 + 1 + 1 + 1
    assert cost("def f():\n  if a: pass") == 1
