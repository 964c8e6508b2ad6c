"""Confidence of mappings: evidence, diversity, conflicts, score and tier; selection, coverage, review and conflict resolution.

A mapping has ``provenance``, an array of (source, confidence), and ``certainty``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.resolution import resolutions

MIN_CONFIDENCE = 0.4


def _has(*parts: str) -> Column:
    return F.exists("provenance", lambda p: _in(p["source"], *parts))


def _in(source: Column, *parts: str) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | F.contains(source, F.lit(x))
    return out


def _mean(test=None) -> Column:
    """Mean confidence of the records that pass the test; null for none."""
    rows = F.col("provenance") if test is None else F.filter("provenance", test)
    total = F.aggregate(F.transform(rows, lambda p: p["confidence"]), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(rows) > 0, total / F.size(rows))


def scored(mappings: DataFrame) -> DataFrame:
    """Adds evidence_count, diversity, penalties, score and tier, in that order of dependence."""
    n = F.size("provenance")
    out = mappings.withColumn("evidence_count", n)
    unique = F.size(F.array_distinct(F.transform("provenance", lambda p: p["source"])))
    out = out.withColumn("diversity", F.when(n > 0, F.least(F.lit(1.0), unique / F.least(n, F.lit(5)))).otherwise(0.0))
    confidences = F.transform("provenance", lambda p: p["confidence"])
    spread = F.when((n >= 2) & (F.array_max(confidences) - F.array_min(confidences) > 0.3), 0.10)
    static, dynamic = _mean(lambda p: _in(p["source"], "static")), _mean(lambda p: _in(p["source"], "dynamic", "runtime"))
    apart = F.when((n >= 2) & (F.abs(static - dynamic) > 0.25), 0.15)
    out = out.withColumn("penalties", F.array_compact(F.array(spread, apart)))
    penalty = F.aggregate("penalties", F.lit(0.0), lambda a, x: a + x)
    raw = (_mean() + 0.1 * F.col("diversity")) * F.col("certainty") - 0.05 * penalty
    out = out.withColumn("score", F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0))
    has_static, has_dynamic = _has("static"), _has("dynamic", "runtime")
    tier = F.when(_has("human", "review"), "human_reviewed").when(has_static & has_dynamic & (F.col("score") >= 0.65), "static_plus_runtime").when(has_dynamic & ~has_static & (F.col("score") >= RUNTIME_ONLY), "runtime_only").otherwise("static_only")
    return out.withColumn("tier", tier)


#: The least score of a mapping that only traces support.
RUNTIME_ONLY = 0.4


def with_static_evidence(matches: DataFrame) -> DataFrame:
    """Rule matches as mappings: one record of static analysis with the rule's confidence."""
    return matches.withColumn("provenance", F.array(F.struct(F.lit("static_analysis").alias("source"), F.col("confidence").cast("double").alias("confidence"))))


#: Scores below are low.
LOW_CONFIDENCE = 0.6


def low_confidence(mappings: DataFrame, below: float = LOW_CONFIDENCE) -> DataFrame:
    """Scored mappings with a score below the bound."""
    return mappings.filter(F.col("score") < below)


def conflicted(mappings: DataFrame) -> DataFrame:
    """Scored mappings with a penalty for evidence that disagrees."""
    return mappings.filter(F.size("penalties") > 0)


def by_tier(mappings: DataFrame, tier: str) -> DataFrame:
    return mappings.filter(F.col("tier") == tier)


def by_kind(mappings: DataFrame, kind: str) -> DataFrame:
    return mappings.filter(F.col("kind") == kind)


def confident(mappings: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    return mappings.filter(F.col("score") >= least)


def coverage(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: mapped_nodes, total_nodes, percent of nodes that stand in a mapping's fragment."""
    mapped = mappings.select(F.explode("node_ids").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("mapped_nodes"))
    return mapped.crossJoin(nodes.agg(F.count(F.lit(1)).alias("total_nodes"))).withColumn("percent", F.when(F.col("total_nodes") > 0, F.round(100 * F.col("mapped_nodes") / F.col("total_nodes"), 2)).otherwise(0.0))


def report(mappings: DataFrame) -> DataFrame:
    """kind, tier, count, mean, least and greatest score by kind and tier, by kind, by tier, and in all."""
    return mappings.groupingSets([["kind", "tier"], ["kind"], ["tier"], []], "kind", "tier").agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("greatest"))


def resolved(mappings: DataFrame) -> DataFrame:
    """The mappings that stay when those that share a node are played off against each other, pair by pair in the order of their ids.

    Of a pair that is still there, the one with the greater (priority, confidence) stays, of equals the first. ``resolution.resolutions`` says who dropped whom.
    """
    return mappings.join(resolutions(mappings).filter("kept"), "mapping_id", "left_semi")


def reviewed(mappings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mappings after review. ``decisions``: mapping_id, decision (accept, reject, edit), label.

    Accepting sets the tier human_reviewed and adds 0.15 to the score (up to 1) unless it had that tier; rejecting sets the score to 0; editing replaces the label.
    """
    out = mappings.join(decisions.select("mapping_id", "decision", F.col("label").alias("__label")), "mapping_id", "left")
    accept, human = F.col("decision") == "accept", F.col("tier") == "human_reviewed"
    status = F.when(accept, "accepted").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "edit", "edited").otherwise("pending")
    score = F.when(accept & ~human, F.least(F.lit(1.0), F.col("score") + 0.15)).when(F.col("decision") == "reject", 0.0).otherwise(F.col("score"))
    label = F.when(F.col("decision") == "edit", F.coalesce("__label", "kind")).otherwise(F.col("kind"))
    return out.withColumns({"status": status, "score": score, "tier": F.when(accept, "human_reviewed").otherwise(F.col("tier")), "label": label}).drop("decision", "__label")


def calibration(mappings: DataFrame) -> DataFrame:
    """rule, accepted, rejected, total, precision (null without either), review_coverage by rule."""
    is_ = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    out = mappings.groupBy("rule").agg(is_("accepted").alias("accepted"), is_("rejected").alias("rejected"), F.count(F.lit(1)).alias("total"))
    known = F.col("accepted") + F.col("rejected")
    return out.withColumns({"precision": F.when(known > 0, F.col("accepted") / known), "review_coverage": known / F.col("total")})


def split(mappings: DataFrame, parts: DataFrame) -> DataFrame:
    """Mappings with those in ``parts`` (mapping_id, pieces: array of structs of kind and node_ids) replaced by ``<id>_split_<i>``."""
    cut = mappings.join(parts, "mapping_id").select("*", F.posexplode("pieces").alias("i", "piece"))
    cut = cut.withColumns({"mapping_id": F.concat("mapping_id", F.lit("_split_"), F.col("i").cast("string")), "kind": F.col("piece.kind"), "node_ids": F.col("piece.node_ids")})
    return mappings.join(parts.select("mapping_id"), "mapping_id", "left_anti").unionByName(cut.select(mappings.columns))


def joined(mappings: DataFrame, groups: DataFrame) -> DataFrame:
    """merged id, kind and fragment of groups (mapping_id, grp): the first mapping's kind, the union of the nodes; named by the first 8 characters of the ids."""
    rows = mappings.join(groups, "mapping_id").groupBy("grp").agg(F.array_sort(F.collect_list("mapping_id")).alias("ids"), F.min_by("kind", "mapping_id").alias("kind"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("node_ids")))).alias("node_ids"))
    return rows.select(F.concat(F.lit("merged_"), F.array_join(F.transform("ids", lambda x: F.substring(x, 1, 8)), "_")).alias("mapping_id"), "kind", "node_ids")
