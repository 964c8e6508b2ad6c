"""Coverage databases as a source, and what was seen at run time in nodes and edges."""

import random
import sqlite3

import pytest

from graphloom.operators.enrichment import coverage_marks, enriched
from graphloom.operators.graph import PropertyGraph
from graphloom.sources import coverage_db


def numbits(lines):
    out = bytearray(max(lines, default=-1) // 8 + 1)
    for n in lines:
        out[n // 8] |= 1 << n % 8
    return bytes(out)


def database(path, files, *, contexts=None, plain=False):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE file (id INTEGER PRIMARY KEY, path TEXT)")
    con.executemany("INSERT INTO file VALUES (?, ?)", [(i * 3 + 1, f) for i, f in enumerate(files)])
    if plain:
        con.execute("CREATE TABLE line (file_id INTEGER, lineno INTEGER)")
        con.executemany("INSERT INTO line VALUES (?, ?)", [(i * 3 + 1, n) for i, f in enumerate(files) for n in files[f]])
    else:
        con.execute("CREATE TABLE context (id INTEGER PRIMARY KEY, context TEXT)")
        con.execute("CREATE TABLE line_bits (file_id INTEGER, context_id INTEGER, numbits BLOB)")
        for k, c in enumerate(contexts or [""]):
            con.execute("INSERT INTO context VALUES (?, ?)", (k, c))
            con.executemany("INSERT INTO line_bits VALUES (?, ?, ?)", [(i * 3 + 1, k, numbits(files[f])) for i, f in enumerate(files)])
    con.commit()
    con.close()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d, rng = tmp_path_factory.mktemp("coverage"), random.Random(2)
    (d / "sub").mkdir()
    files = {f"src/m{i}.py": sorted(rng.sample(range(1, 400), rng.randint(0, 60))) for i in range(40)}
    database(d / "a.coverage", files)
    database(d / "sub/b.coverage", dict(list(files.items())[:5]), contexts=["", "test_x"])
    database(d / "old.coverage", {"old.py": [1, 2, 9]}, plain=True)
    database(d / "empty.coverage", {})
    (d / "no.coverage").write_bytes(b"SQLite format 3\0" + b"broken" * 100)
    (d / "text.coverage").write_text("no database")
    con = sqlite3.connect(d / "other.coverage")
    con.execute("CREATE TABLE t (x)")
    con.close()
    want = [("a.coverage", "", f, n) for f, x in files.items() for n in x] + [("old.coverage", "", "old.py", n) for n in (1, 2, 9)]
    want += [("b.coverage", c, f, n) for f, x in list(files.items())[:5] for n in x for c in ("", "test_x")]
    return d, sorted(want)


def test_databases_of_a_folder(spark, folder):
    d, want = folder
    coverage_db.register(spark)
    df = spark.read.format("coverage_db").option("path", str(d)).option("pattern", "*.coverage").option("filesPerPartition", 7).load()
    got = lambda x: sorted((r.database.rpartition("/")[2], r.context, r.file, r.line) for r in x.collect())
    assert got(df) == want and df.rdd.getNumPartitions() > 15
    assert got(df.filter("file = 'src/m3.py' AND line > 100")) == [w for w in want if w[2] == "src/m3.py" and w[3] > 100]
    assert got(df.filter("file IN ('src/m3.py', 'old.py', 'none')")) == [w for w in want if w[2] in ("src/m3.py", "old.py")]
    assert got(coverage_db.coverage_databases(spark, str(d), pattern="*.coverage")) == want
    one = spark.read.format("coverage_db").option("path", str(d / "old.coverage")).load()
    assert [r.line for r in one.orderBy("line").collect()] == [1, 2, 9]
    with pytest.raises(Exception, match="no database|not a database|malformed|file is not"):
        spark.read.format("coverage_db").option("path", str(d)).option("broken", "fail").load().count()


def test_the_file_condition_is_evaluated_by_the_database(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = coverage_db._Reader({"path": str(folder[0])})
    more = GreaterThan(("line",), 3)
    assert list(reader.pushFilters([EqualTo(("file",), "old.py"), more])) == [more] and reader.wanted == ["old.py"]
    assert {b.column("file")[0].as_py() for p in reader.partitions() for b in reader.read(p) if b.num_rows} == {"old.py"}


def test_lines_of_a_database_in_nested_spans(spark, folder):
    d, want = folder
    rng = random.Random(5)
    spans = []
    for i in range(300):
        a = rng.randint(0, 390)
        spans.append((f"n{i}", f"./src/m{i % 45}.py", a, a + rng.choice([0, 3, 40, 3000, 100_000])))
    spans += [("null", "src/m1.py", None, 5), ("back", "src/m1.py", 9, 5), ("none", None, 1, 9)]
    nodes = spark.createDataFrame(spans, "id string, path string, start_line int, end_line int")
    coverage_db.register(spark)
    lines = spark.read.format("coverage_db").option("path", str(d / "a.coverage")).load().selectExpr("file", "line", "1 AS hits")
    got = {r.id: r.coverage_hits for r in coverage_marks(nodes, lines).collect()}
    rows = [w for w in want if w[0] == "a.coverage"]
    count = {s[0]: sum(w[2] == s[1][2:] and s[2] <= w[3] <= s[3] for w in rows) for s in spans[:300]}
    assert got == {k: v for k, v in count.items() if v} and len(got) > 150


def test_marks_in_nodes_and_edges(spark):
    nodes = spark.createDataFrame(
        [("a", "function", "main", "m.main", "m.py", 1, 9, {"k": "v", "coverage_hits": "old"}), ("b", "method", "run", "m.C.run", "m.py", 2, 3, None), ("c", "function", "run", "m.run", "x.py", 1, 3, {}), ("d", "class", "main", "main", "m.py", 1, 1, {"x": "y"})],
        "id string, kind string, name string, qualified_name string, path string, start_line int, end_line int, metadata map<string,string>",
    )
    edges = spark.createDataFrame([("e", "a", "b", "calls", 1.0, ["static"]), ("f", "a", "b", "reads", 1.0, None)], "id string, source_id string, target_id string, kind string, weight double, evidence_sources array<string>")
    lines = spark.createDataFrame([("m.py", 2, 1, True), ("m.py", 2, 0, True), ("m.py", 3, 4, False), ("m.py", 8, 0, False)], "file string, line int, hits int, is_branch boolean")
    events = spark.createDataFrame([(0, "main", "B", 0, 0, 1, 1), (1, "run", "X", 10, 2000, 1, 1), (2, "run", "X", 20, 4000, 1, 1), (3, "m.C.run", "X", 30, 9000, 1, 1), (4, "main", "E", 90, 0, 1, 1)], "seq long, name string, ph string, ts long, dur long, pid int, tid int")
    g = enriched(PropertyGraph(nodes, edges), lines=lines, events=events)
    meta = {r.id: r.metadata for r in g.nodes.collect()}
    assert g.nodes.columns == nodes.columns
    assert meta["a"] == {"k": "v", "coverage_hits": "2", "branch_coverage": "0.5", "call_count": "1", "avg_duration_ms": "0.09", "is_hot_path": "false"}
    assert meta["b"] == {"coverage_hits": "2", "branch_coverage": "0.5", "call_count": "1", "avg_duration_ms": "9.0", "is_hot_path": "true"}
    assert meta["c"] == {"call_count": "2", "avg_duration_ms": "3.0", "is_hot_path": "false"} and meta["d"] == {"x": "y"}
    got = {(r.source_id, r.target_id, r.kind): (r.weight, r.evidence_sources) for r in g.edges.collect()}
    assert got == {("a", "b", "calls"): (2.0, ["static", "dynamic_trace"]), ("a", "b", "reads"): (1.0, None), ("a", "c", "calls"): (2.0, ["dynamic_trace"])}
    bare = enriched(PropertyGraph(nodes.drop("metadata"), edges.drop("evidence_sources")), events=events.limit(0))
    assert bare.nodes.filter("metadata IS NOT NULL").count() == 0 and bare.edges.count() == 2
