"""A model kept up to date by deltas against one compiled from scratch."""

import random

from graphloom.operators import incremental as inc

M = "path string, mapping_id string, kind string, node_id string, score double"
E = "path string, source_id string, target_id string, kind string"


def random_file(rng, path):
    """Mappings and edges of one file; facts of different files can be equal."""
    node = lambda: f"n{rng.randrange(8)}"
    mappings = [(path, f"m{rng.randrange(6)}", rng.choice(["hidden_state", "observation", "action", "policy", "context"]), node(), rng.choice([0.25, 0.5])) for _ in range(rng.randrange(4))]
    return mappings, [(path, node(), node(), rng.choice(["reads", "writes", "mutates", "calls"])) for _ in range(rng.randrange(6))]


def frames(spark, files):
    m, e = [r for a, _ in files.values() for r in a], [r for _, b in files.values() for r in b]
    sums = [(p, repr((a[0] and [r[1:] for r in a[0]], [r[1:] for r in a[1]]))) for p, a in files.items()]
    return spark.createDataFrame(m, M), spark.createDataFrame(e, E), spark.createDataFrame(sums, "path string, checksum string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_any_sequence_of_changes_gives_what_a_compile_from_scratch_gives(spark):
    rng = random.Random(12)
    files = {f"f{i}.py": random_file(rng, f"f{i}.py") for i in range(6)}
    m, e, sums = frames(spark, files)
    model = inc.compiled(m, e)
    for step in range(3):
        files = {p: v for p, v in files.items() if rng.random() > 0.25}
        for p in [*rng.sample(sorted(files), min(2, len(files))), f"new{step}.py"]:
            files[p] = random_file(rng, p)
        m2, e2, sums2 = frames(spark, files)
        changes = inc.source_changes(sums, sums2)
        model = inc.updated(model, inc.facts_delta(m, m2, changes, inc.FACTS["mappings"]), inc.facts_delta(e, e2, changes, inc.FACTS["edges"]))
        scratch = inc.compiled(m2, e2)
        assert rows(model.rows) == rows(scratch.rows) and rows(model.mappings) == rows(scratch.mappings) and rows(model.edges) == rows(scratch.edges)
        assert model.rows.filter("n <= 0").isEmpty()
        m, e, sums = m2, e2, sums2
    assert rows(inc.state_space(model)) == rows(inc.state_space(scratch)) and len(rows(model.rows)) > 5
    none = inc.facts_delta(m, m, inc.source_changes(sums, sums), inc.FACTS["mappings"])
    assert none.isEmpty()


def test_changes_keep_deletions_and_find_renamings(spark):
    old = spark.createDataFrame([("a.py", "1"), ("b.py", "2"), ("c.py", "3"), ("d.md", "4"), ("same.py", "5"), ("x.py", "9"), ("y.py", "9")], "path string, checksum string")
    new = spark.createDataFrame([("a.py", "1x"), ("moved.py", "2"), ("e.md", "6"), ("same.py", "5"), ("z.PY", "9")], "path string, checksum string")
    got = rows(inc.source_changes(old, new))
    assert got == sorted([("M", "a.py", None), ("R", "moved.py", "b.py"), ("D", "c.py", None), ("D", "d.md", None), ("A", "e.md", None), ("R", "z.PY", "x.py"), ("D", "y.py", None)], key=repr)
    assert {r[1] for r in rows(inc.source_changes(old, new, extensions=[".py"]))} == {"a.py", "moved.py", "c.py", "z.PY", "y.py"}
