"""Every query with SQL gives what the SQL gives, at the smallest scale."""

import os

import duckdb
import pytest

from graphloom.plans import registry

D = "/root/testdata/sf0.001"
FAST = [n for n in registry.oracle_sql() if not n.startswith("rule_") and n not in ("translate_scored", "scoring_report", "mapping_coverage")][::4] + ["rule_observation", "rule_containment"]
FAST = list(dict.fromkeys(FAST + ["remove_edges", "weighted_adjacency", "class_cardinality", "top_states", "metric_summary", "low_confidence", "conflicted_mappings", "mappings_by_tier", "mappings_by_kind", "likelihood_scalars", "trace_summary", "state_variables", "action_effects", "confident_mappings", "process_timeline", "module_seeds", "validation_score", "unreachable_nodes", "import_targets", "incremental_merge"]))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_its_sql(spark, con, name):
    df = registry.queries()[name](spark, D)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_entry_point_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["n_nodes", "n_edges", "density", "complexity"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
