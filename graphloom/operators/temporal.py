"""Time regimes of graphs (asynchronous and event nodes, orderings, patterns), and the types of state variables and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import keywords as kw

# Parts of names.
ASYNC_NAMES = ["async", "callback", "promise", "future"]
EVENT_NAMES = ["event", "handler", "listener", "trigger"]


def async_nodes(nodes: DataFrame) -> DataFrame:
    """id of nodes that are asynchronous by their name (or ``metadata`` flags is_async, async)."""
    test = kw.contains_any("name", ASYNC_NAMES)
    if "metadata" in nodes.columns:
        test = test | F.coalesce((F.col("metadata")["is_async"] == "true") | (F.col("metadata")["async"] == "true"), F.lit(False))
    return nodes.filter(test).select("id")


def event_nodes(nodes: DataFrame) -> DataFrame:
    """id of nodes that are events by kind or name (or ``metadata`` flags is_event, event)."""
    test = (F.col("kind") == "event") | kw.contains_any("name", EVENT_NAMES)
    if "metadata" in nodes.columns:
        test = test | F.coalesce((F.col("metadata")["is_event"] == "true") | (F.col("metadata")["event"] == "true"), F.lit(False))
    return nodes.filter(test).select("id")


def _with_async(edges: DataFrame, found: DataFrame) -> DataFrame:
    a = found.select(F.col("id").alias("source_id"), F.lit(True).alias("sa"))
    b = found.select(F.col("id").alias("target_id"), F.lit(True).alias("ta"))
    return edges.join(a, "source_id", "left").join(b, "target_id", "left").withColumn("parallel", F.coalesce("sa", F.lit(False)) | F.coalesce("ta", F.lit(False)))


def orderings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """predecessor, successor, constraint, confidence of calls and triggers: parallel (0.7) with an asynchronous end, else sequential (0.95)."""
    e = _with_async(edges.filter("kind IN ('calls', 'triggers')"), async_nodes(nodes))
    return e.select(F.col("source_id").alias("predecessor"), F.col("target_id").alias("successor"), F.when(F.col("parallel"), "parallel").otherwise("sequential").alias("constraint"), F.when(F.col("parallel"), 0.7).otherwise(0.95).alias("confidence"))


def event_patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, triggered_by, handled_by: triggers into and out of event nodes that have any."""
    ev, t = event_nodes(nodes), edges.filter("kind = 'triggers'")
    ends = t.select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(t.select("source_id", F.lit(0), F.lit(1)))
    return ends.join(ev, "id", "left_semi").groupBy("id").agg(F.sum("i").alias("triggered_by"), F.sum("o").alias("handled_by"))


def regime(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: fractions of asynchronous and event nodes, parallel and sequential edges, event patterns, and the regime that follows."""
    a, ev = async_nodes(nodes), event_nodes(nodes)
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    na, ne = a.agg(F.count(F.lit(1)).alias("na")), ev.agg(F.count(F.lit(1)).alias("ne"))
    e = _with_async(edges, a).agg(F.count_if("parallel").alias("parallel_edges"), F.count_if(~F.col("parallel")).alias("sequential_edges"))
    p = event_patterns(nodes, edges).agg(F.count(F.lit(1)).alias("event_patterns"))
    row = n.crossJoin(na).crossJoin(ne).crossJoin(e).crossJoin(p)  # one row each
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    driven = (F.col("ne") > 0) & (F.col("event_patterns") > 0)
    kind = F.when(driven & (F.col("na") > 0), "hybrid").when(driven, "event_driven").when(F.col("na") > 0, "asynchronous").otherwise("synchronous")
    return row.select(share("na").alias("async_fraction"), share("ne").alias("event_fraction"), "parallel_edges", "sequential_edges", "event_patterns", kind.alias("regime"))


def variable_type(hint: str | Column, description: str | Column) -> Column:
    """Type of a state variable by its type hint, else by words of its description, else discrete."""
    h, d = (F.col(x) if isinstance(x, str) else x for x in (hint, description))
    d = F.lower(F.coalesce(d, F.lit("")))
    has = lambda *words: kw.contains_any(d, list(words))
    by_hint = F.when(h.isin("bool", "boolean"), "boolean").when(h.isin("int", "integer"), "discrete").when(h.isin("float", "real"), "continuous").when(h.isin("str", "string"), "categorical").when(h.contains("list") | h.contains("array"), "vector").when(h.isin("dict", "object"), "composite")
    return F.coalesce(by_hint, F.when(has("flag", "enabled", "active"), "boolean").when(has("count", "index", "num"), "discrete").when(has("rate", "prob", "value"), "continuous").otherwise("discrete"))


def modality_type(name: str | Column, description: str | Column) -> Column:
    """Type of an observation: the first of log, metric, event, sensor that its name or description holds, else generic."""
    n, d = (F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))) for x in (name, description))
    out = F.lit("generic")
    for word in ("sensor", "event", "metric", "log"):
        out = F.when(n.contains(word) | d.contains(word), word).otherwise(out)
    return out


def distribution(var_type: str | Column, cardinality: str | Column) -> Column:
    t, c = (F.col(x) if isinstance(x, str) else x for x in (var_type, cardinality))
    return F.when((t == "boolean") | ((t == "discrete") & c.eqNullSafe(2)), "bernoulli").when(t.isin("discrete", "categorical"), "categorical").when(t == "continuous", "gaussian").otherwise("unknown")


def dimensionality(variables: DataFrame) -> DataFrame:
    """One row: the product of known cardinalities of variables that aren't continuous, times two for each continuous one, as a logarithm to base 2."""
    c = F.col("var_type") == "continuous"
    return variables.agg(F.coalesce(F.sum(F.when(~c & (F.col("cardinality") > 0), F.log2(F.col("cardinality").cast("double"))).otherwise(0.0)) + F.count_if(c), F.lit(0.0)).alias("log2_size"))


def factorization(touches: DataFrame) -> DataFrame:
    """variable, dependencies, independence of variables that share targets with a later one.

    ``touches``: variable, target, mode (writes, reads). A later variable is a dependency if it writes a target that this one writes or reads.
    Both sides meet by target, so variables without common targets are never paired.
    """
    t = touches.select("variable", "target", "mode").distinct()
    own = t.select("variable", "target").distinct()
    later = t.filter("mode = 'writes'").select(F.col("variable").alias("other"), "target")
    shared = own.join(later, "target").filter("variable < other")
    size = own.groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
    out = shared.groupBy("variable").agg(F.count_distinct("other").alias("dependencies"), F.count_distinct("target").alias("shared"))
    return out.join(size, "variable").select("variable", "dependencies", F.greatest(F.lit(0.0), 1 - F.col("shared") / F.col("n")).alias("independence"))


def interface_nodes(scores: DataFrame) -> DataFrame:
    """id, score of the top quarter (one at least) of nodes by score, ties by id."""
    return scores.orderBy(F.desc("score"), "id").limit(max(1, scores.count() // 4)).select("id", "score")


def in_range(stages: DataFrame, start: float, end: float) -> DataFrame:
    """Stages (start, end) that overlap a time range."""
    return stages.filter((F.col("start") < end) & (F.col("end") > start))
