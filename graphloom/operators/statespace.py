"""State-space models: variables, observations and actions of labelled graphs, and sparse probability matrices.

Matrices are long tables: A (o, s, p), B (s_next, s, a, p), C (o, v), D (s, p). Columns sum to one over the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence_level(score: str | Column) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= 0.95, "certain").when(c >= 0.80, "high").when(c >= 0.60, "medium").when(c >= 0.40, "low").otherwise("speculative")


def entities(mappings: DataFrame, nodes: DataFrame, kinds: list[str], *, last: bool, prefix: str = "") -> DataFrame:
    """id, node_id, name, mapping_id, score: one for each node of the fragments of mappings of these kinds; the last or the first mapping by id counts."""
    rows = mappings.filter(F.col("kind").isin(kinds)).select("mapping_id", "score", F.explode("node_ids").alias("node_id"))
    order = F.desc("mapping_id") if last else F.asc("mapping_id")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy(order))).filter("r = 1")
    return rows.join(nodes.select(F.col("id").alias("node_id"), "name"), "node_id").select(F.concat(F.lit(prefix), "node_id").alias("id"), "node_id", "name", "mapping_id", "score")


def variables(mappings: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """State variables: hidden states with their cardinality (methods of a class), and whether anything observes them."""
    v = entities(mappings, nodes, ["hidden_state"], last=True)
    methods = edges.filter("kind = 'contains'").join(nodes.filter("kind = 'method'").select(F.col("id").alias("target_id")), "target_id").groupBy(F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("cardinality"))
    seen = edges.filter("kind IN ('reads', 'observes')").select(F.col("target_id").alias("node_id")).distinct().withColumn("observable", F.lit(True))
    return v.join(methods, "node_id", "left").join(seen, "node_id", "left").select("id", "node_id", "name", "score", confidence_level("score").alias("level"), "cardinality", F.coalesce("observable", F.lit(False)).alias("observable"))


def action_effects(actions: DataFrame, variables: DataFrame, edges: DataFrame) -> DataFrame:
    """action, variable, effect (reads or writes) of actions on state variables by the edges between their nodes."""
    kind = F.when(F.col("kind").isin("writes", "mutates"), "writes").when(F.col("kind").isin("reads", "observes"), "reads")
    e = edges.select(F.col("source_id").alias("an"), F.col("target_id").alias("vn"), kind.alias("effect")).filter("effect IS NOT NULL").distinct()
    return e.join(actions.select(F.col("id").alias("action"), F.col("node_id").alias("an")), "an").join(variables.select(F.col("id").alias("variable"), F.col("node_id").alias("vn")), "vn").select("action", "variable", "effect")


def normalised(df: DataFrame, by: list[str], value: str = "p") -> DataFrame:
    """Values over their sum within ``by``; uniform where the sum is (nearly) 0."""
    w = Window.partitionBy(*by)
    total, n = F.sum(value).over(w), F.count(F.lit(1)).over(w)
    return df.withColumn("__t", total).withColumn("__n", n).withColumn(value, F.when(F.col("__t") <= 1e-9, 1 / F.col("__n")).otherwise(F.col(value) / F.col("__t"))).drop("__t", "__n")


def matrix_a(observations: DataFrame, states: DataFrame, direct: DataFrame) -> DataFrame:
    """o, s, p. Each observation gives 0.9 to the states that it is directly tied to (``direct``: o, s) and 0.1 to the others, or all alike; then columns are normalised.

    Both dimensions are the model's, not the corpus', and the matrix is dense by definition.
    """
    tied = direct.select("o", "s").distinct().join(observations, "o", "left_semi").join(states, "s", "left_semi")
    k = tied.groupBy("o").agg(F.count(F.lit(1)).alias("k"))
    n = states.agg(F.count(F.lit(1)).alias("n"))
    dense = observations.select("o").join(k, "o", "left").crossJoin(F.broadcast(n)).crossJoin(states.select("s")).join(tied.withColumn("tied", F.lit(True)), ["o", "s"], "left")
    p = F.when(F.col("k").isNull(), 1 / F.col("n")).when(F.col("k") == F.col("n"), 1 / F.col("n")).when(F.col("tied"), 0.9 / F.col("k")).otherwise(0.1 / (F.col("n") - F.col("k")))
    return normalised(dense.select("o", "s", p.alias("p")), ["s"])


def matrix_b(states: DataFrame, actions: DataFrame, written: DataFrame) -> DataFrame:
    """s_next, s, a, p without zeros. An action that writes no state keeps it; else 0.9 goes to the states it writes, and 0.1 stays if the current one isn't among them."""
    w = written.select("a", "s").distinct().join(actions, "a", "left_semi").join(states, "s", "left_semi")
    k = w.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    grid = actions.select("a").join(k, "a", "left").crossJoin(states.select("s"))  # dimensions of the model
    stay = grid.join(w.withColumn("hit", F.lit(True)), ["a", "s"], "left").filter("k IS NULL OR hit IS NULL").select(F.col("s").alias("s_next"), "s", "a", F.when(F.col("k").isNull(), 1.0).otherwise(0.1).alias("p"))
    go = grid.filter("k IS NOT NULL").join(w.select("a", F.col("s").alias("s_next")), "a").select("s_next", "s", "a", (0.9 / F.col("k")).alias("p"))
    return normalised(stay.union(go), ["s", "a"])


def vector_c(observations: DataFrame, constraints: DataFrame) -> DataFrame:
    """o, v: the sum of signed confidences of constraints (o, confidence, kind, label) on each observation; a preference to avoid, reject or negate counts against it."""
    against = (F.col("kind") == "preference") & (F.lower("label").contains("avoid") | F.lower("label").contains("reject") | F.col("label").contains("!"))
    total = constraints.withColumn("x", F.when(against, -F.col("confidence")).otherwise(F.col("confidence"))).groupBy("o").agg(F.sum("x").alias("v"))
    return observations.select("o").join(total, "o", "left").na.fill(0.0, ["v"])


def vector_d(states: DataFrame) -> DataFrame:
    """s, p from ``weight`` (1, more with a known domain or a configuration beside it), normalised."""
    return normalised(states.select("s", F.col("weight").cast("double").alias("p"), F.lit(0).alias("one")), ["one"]).select("s", "p")


def violations(df: DataFrame, by: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Columns of a matrix whose sum is not 1 or that hold a negative value."""
    return df.groupBy(*by).agg(F.sum("p").alias("total"), F.min("p").alias("least")).filter((F.abs(F.col("total") - 1) > tolerance) | (F.col("least") < -1e-9))


def transition_counts(events: DataFrame) -> DataFrame:
    """s, s_next, n of consecutive events (who, ts, seq, state)."""
    w = Window.partitionBy("who").orderBy("ts", "seq")
    return events.withColumn("s_next", F.lead("state").over(w)).filter("s_next IS NOT NULL").groupBy(F.col("state").alias("s"), "s_next").agg(F.count(F.lit(1)).alias("n"))


# --- vectors as arrays of doubles ---


def entropy(p: str) -> Column:
    return -F.aggregate(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def kl(p: str, q: str) -> Column:
    """Sum of p ln(p / q); infinite where q is 0 and p is not."""
    term = lambda x, y: F.when(x <= 0, 0.0).when(y <= 0, F.lit(float("inf"))).otherwise(x * F.log(x / y))
    return F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x)


def bayes(prior: str, likelihood: str) -> Column:
    """Posterior of a prior and the observation's row of A; the prior where their product has no mass."""
    joint = F.zip_with(prior, likelihood, lambda x, y: x * y)
    total = F.aggregate(joint, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(joint, lambda x: x / total)).otherwise(F.col(prior))


def free_energy(belief: str, prior: str, likelihood: str, *, floor: float = 1e-16) -> Column:
    """KL of the belief to the prior less the expected log-likelihood of the observation."""
    gain = F.aggregate(F.zip_with(belief, likelihood, lambda x, y: x * F.log(F.greatest(y, F.lit(floor)))), F.lit(0.0), lambda a, x: a + x)
    term = lambda x, y: F.when(x > 0, x * (F.log(x) - F.log(F.greatest(y, F.lit(floor))))).otherwise(0.0)
    return F.aggregate(F.zip_with(belief, prior, term), F.lit(0.0), lambda a, x: a + x) - gain


def uniform(n: int) -> Column:
    """n equal probabilities."""
    return F.array_repeat(F.lit(1.0 / n), n)


def accuracy(belief: str, likelihood: str, *, floor: float = 1e-16) -> Column:
    """Expected log-likelihood of an observation under a belief."""
    return F.aggregate(F.zip_with(belief, likelihood, lambda x, y: x * F.log(F.greatest(y, F.lit(floor)))), F.lit(0.0), lambda a, x: a + x)


def surprisal(belief: str, likelihood: str) -> Column:
    """The accuracy term with its sign changed (not the observation's own -log p)."""
    return -accuracy(belief, likelihood)


def log_probability(p: str, at: int) -> Column:
    """ln of one category's probability; minus infinity for 0 or a category that is not there."""
    x = F.get(p, F.lit(at))
    return F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf")))


def models_of_steps(steps: DataFrame, states: list[str]) -> DataFrame:
    """A small model for each agent from its own steps (agent, value, next), in the form of ``inference.run_models``.

    States and observations are the ``states``; an observation is its state's with 0.9. The first action stays, the second follows the shares of the agent's own steps (from a state that it
    never left, all alike). Preferences and the first belief are the shares of the values that it left.
    """
    n = len(states)
    counts = steps.groupBy("agent", "value", "next").agg(F.count(F.lit(1)).alias("k"))
    left = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x01", "value", "next"), "k")))  # a row for each two states at most
    own = counts.groupBy("agent").agg(left.alias("k"))
    k = lambda s, t: F.coalesce(F.col("k")[f"{s}\x01{t}"], F.lit(0))
    total = {s: sum((k(s, t) for t in states), F.lit(0)) for s in states}
    every = sum(total.values(), F.lit(0))
    b = [x for t in states for s in states for x in (F.lit(float(s == t)), F.when(total[s] > 0, k(s, t) / total[s]).otherwise(1.0 / n))]
    share = F.array(*[total[s] / every for s in states])
    a = F.array(*[F.lit(1.0 if n == 1 else 0.9 if s == o else 0.1 / (n - 1)) for o in states for s in states])
    return own.select(F.col("agent").cast("string").alias("agent"), F.lit(n).alias("states"), F.lit(2).alias("actions"), a.alias("a"), F.array(*b).alias("b"), share.alias("c"), share.alias("d"))
