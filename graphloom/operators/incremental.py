"""Compiling a state space from facts by file, and keeping it up to date by deltas.

A model is kept as tables of rows with ``n``, the number of facts (or of combinations of facts) that a row follows from. A change of files is a delta of facts with signs: what stood in
changed and deleted files counts -1, what stands in changed and new ones 1. Rows of the model are sums of products of facts, so a delta of the facts gives the rows' delta by joins in
which one side is a delta (of three factors the ones before it are taken as they were, those after it as they are); rows that come to 0 go. A file that is the same by
its checksum takes no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.storage import stored

FACTS = {"mappings": ["mapping_id", "kind", "node_id", "score"], "edges": ["source_id", "target_id", "kind"]}
ROWS = ["part", "id", "other", "detail", "mapping_id", "score"]
# Parts of a model by the kind of a mapping, and effects by the kind of an edge.
PARTS = {"hidden_state": "variable", "observation": "observation", "action": "action", "policy": "action"}
EFFECTS = {"writes": "writes", "mutates": "writes", "reads": "reads", "observes": "reads"}


@dataclass(frozen=True)
class Compiled:
    """Counted facts and counted rows of a model."""

    mappings: DataFrame
    edges: DataFrame
    rows: DataFrame


def source_changes(old: DataFrame, new: DataFrame, *, extensions: list[str] | None = None) -> DataFrame:
    """change (A, M, D, R), path, old_path of two versions of path, checksum: a deleted file whose content stands in a new one is its renaming (the smallest of equals)."""
    both = old.select("path", F.col("checksum").alias("a")).join(new.select("path", F.col("checksum").alias("b")), "path", "full")
    changed = stored(both.filter("NOT a <=> b"), "changes")
    gone, come = changed.filter("b IS NULL").select(F.col("a").alias("sum"), F.col("path").alias("old_path")), changed.filter("a IS NULL").select(F.col("b").alias("sum"), "path")
    first = lambda d, c: d.groupBy("sum").agg(F.min(c).alias(c))
    moved = stored(first(gone, "old_path").join(first(come, "path"), "sum").select("path", "old_path"), "moved")
    rest = changed.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    kind = F.when(F.col("a").isNull(), "A").when(F.col("b").isNull(), "D").otherwise("M")
    out = rest.select(kind.alias("change"), "path", F.lit(None).cast("string").alias("old_path")).union(moved.select(F.lit("R"), "path", "old_path"))
    return out if extensions is None else out.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(extensions))


def facts_delta(old: DataFrame, new: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and n (1 or -1, summed) of the facts (path and ``columns``) of changed files."""
    paths = stored(changes.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct(), "changed-paths")
    signed = lambda d, n: d.join(paths, "path", "left_semi").select(*columns, F.lit(n).cast("long").alias("n"))
    return counted(signed(old, -1).unionByName(signed(new, 1)), columns)


def counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of ``n`` (1 where there is none) for equal rows; those at 0 are left out."""
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    return rows.groupBy(*columns).agg(n.alias("n")).filter("n <> 0")


def _of(mappings: DataFrame, *kinds: str) -> DataFrame:
    return mappings.filter(F.col("kind").isin(*kinds))


def _alone(mappings: DataFrame) -> DataFrame:
    """Rows of the model that follow from one mapping each."""
    part = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])[F.col("kind")]
    none = F.lit("")
    return mappings.select(part.alias("part"), F.col("node_id").alias("id"), none.alias("other"), none.alias("detail"), "mapping_id", "score", "n").filter("part IS NOT NULL")


def _effects(actions: DataFrame, edges: DataFrame, variables: DataFrame) -> DataFrame:
    """Rows that follow from an action, an edge and a variable: effects (what it writes) and preconditions (what it reads)."""
    effect = F.create_map(*[F.lit(x) for kv in EFFECTS.items() for x in kv])[F.col("kind")]
    a = actions.select(F.col("node_id").alias("source_id"), F.col("n").alias("na"))
    v = variables.select(F.col("node_id").alias("target_id"), F.col("n").alias("nv"))
    e = edges.select("source_id", "target_id", effect.alias("detail"), "n").filter("detail IS NOT NULL")
    both = e.join(a, "source_id").join(v, "target_id")
    part = F.when(F.col("detail") == "writes", "effect").otherwise("precondition")
    return both.select(part.alias("part"), F.col("source_id").alias("id"), F.col("target_id").alias("other"), "detail", F.lit("").alias("mapping_id"), F.lit(None).cast("double").alias("score"), (F.col("n") * F.col("na") * F.col("nv")).alias("n"))


_ACTIONS, _VARIABLES = ("action", "policy"), ("hidden_state",)


def compiled(mappings: DataFrame, edges: DataFrame) -> Compiled:
    """The model of all facts, from scratch."""
    m, e = stored(counted(mappings.select(FACTS["mappings"]), FACTS["mappings"]), "facts"), stored(counted(edges.select(FACTS["edges"]), FACTS["edges"]), "facts")
    rows = _alone(m).unionByName(_effects(_of(m, *_ACTIONS), e, _of(m, *_VARIABLES)))
    return Compiled(m, e, stored(counted(rows, ROWS), "model"))


def updated(model: Compiled, mappings: DataFrame, edges: DataFrame) -> Compiled:
    """The model after deltas of its facts (``facts_delta``), without compiling what did not change."""
    dm, de = stored(mappings, "delta"), stored(edges, "delta")
    m = stored(counted(model.mappings.unionByName(dm), FACTS["mappings"]), "facts")
    e = stored(counted(model.edges.unionByName(de), FACTS["edges"]), "facts")
    acts, vars_ = (lambda x: _of(x, *_ACTIONS)), (lambda x: _of(x, *_VARIABLES))
    delta = _alone(dm).unionByName(_effects(acts(dm), e, vars_(m))).unionByName(_effects(acts(model.mappings), de, vars_(m))).unionByName(_effects(acts(model.mappings), model.edges, vars_(dm)))
    return Compiled(m, e, stored(counted(model.rows.unionByName(counted(delta, ROWS)), ROWS), "model"))


def state_space(model: Compiled) -> DataFrame:
    """part, id, other, detail, score of a model, each once: of several mappings of one node the last by id counts for variables and observations, the first for actions."""
    last = F.max(F.struct("mapping_id", "score"))["score"]
    first = F.min(F.struct("mapping_id", "score"))["score"]
    return model.rows.groupBy("part", "id", "other", "detail").agg(F.when(F.col("part") == "action", first).otherwise(last).alias("score"))
