"""Communities by modularity: local moves and contraction in turns, as joins and aggregations over edge tables.

Weights are whole numbers (``UNIT`` parts of one), so every sum is exact and the result depends on neither partitions nor order. With M the sum of all degrees and S the sum of
degrees in a community, moving node u from community a to b changes the modularity by 2 / M^2 times (k(u,b) M - k(u) S(b)) - (k(u,a) M - k(u) S(a without u)).

A round lets the nodes on one seeded half of a hash move to their best community. If that does not raise the modularity, as neighbours may have moved past one another, only moves
that are the best of both communities they touch are made; those are disjoint, their gains add up, and the modularity rises. A level ends when a round gains less than ``LEAST_GAIN`` or no
node gains; its communities then become the nodes of the next level. Levels end when a contraction changes nothing, so the modularity never falls.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.storage import stored

UNIT = 1000
SEED = 0
LEAST_GAIN = Fraction(1, 1000)
#: Bounds of the loops; each round and level raises the modularity, so they only cut long tails.
ROUNDS, LEVELS = 30, 12

_D = "decimal(38,0)"
_wide = lambda c: F.col(c).cast("decimal(19,0)")


def _weighted(edges: DataFrame, unit: int) -> DataFrame:
    """u, v, w: each edge with its weight in parts of ``unit``; those without ends or weight are left out."""
    w = F.round(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) * unit).cast("long") if "weight" in edges.columns else F.lit(unit).cast("long")
    return edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"), w.alias("w")).filter("u IS NOT NULL AND v IS NOT NULL AND w > 0")


def undirected(edges: DataFrame, unit: int = UNIT) -> DataFrame:
    """u, v, w: each edge in both directions with the sum of its weights in parts of ``unit``; a self-loop once, with twice its weight."""
    e = _weighted(edges, unit)
    return e.union(e.select("v", "u", "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def _inside(both: DataFrame, labels: DataFrame) -> Fraction:
    """Modularity of labels (id, c) over ``both`` (u, v, w), exact."""
    a, b = labels.toDF("u", "cu"), labels.toDF("v", "cv")
    rows = both.join(a, "u").join(b, "v")
    return _of_sums(rows.groupBy(F.col("cu").alias("c")).agg(F.sum("w").alias("s"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0)).alias("own")))


def _of_sums(per: DataFrame) -> Fraction:
    """Modularity of the sums of degrees (s) and of weights within (own) of each community."""
    total = per.agg(F.sum("s").alias("m"), F.sum("own").alias("own"), F.sum(_wide("s") * _wide("s")).alias("squares")).first()
    return Fraction(int(total.own), int(total.m)) - Fraction(int(total.squares), int(total.m) ** 2) if total.m else Fraction(0)


def modularity(edges: DataFrame, labels: DataFrame, *, unit: int = UNIT) -> float:
    """Modularity of ``labels`` (id, community; each id once) on the undirected graph of ``edges``; 0 without edges."""
    # Sums of whole numbers: an edge counts the same in both directions, and what leads from one community to one node is summed before it meets that node's label.
    e = _weighted(edges, unit)
    into = e.join(labels.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").groupBy("cu", "v").agg(F.sum("w").alias("w"))
    ties = into.join(labels.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v").groupBy("cu", "cv").agg(F.sum("w").alias("w"))
    ends = stored(ties, "ties").select(F.explode(F.array("cu", "cv")).alias("c"), "w", F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0).alias("own"))
    return float(_of_sums(ends.groupBy("c").agg(F.sum("w").alias("s"), F.sum("own").alias("own"))))


def _proposals(both: DataFrame, degrees: DataFrame, labels: DataFrame) -> DataFrame:
    """id, a (own community), b (the best other one, the smallest of equals), gain > 0 (in units of 2 / M^2)."""
    m = degrees.agg(F.sum("k")).first()[0]
    sums = labels.join(degrees, "id").groupBy("c").agg(F.sum("k").alias("s"))
    ties = both.filter("u <> v").join(labels.toDF("v", "c"), "v").groupBy(F.col("u").alias("id"), "c").agg(F.sum("w").alias("w"))
    # A node that no longer touches its own community still compares with it.
    own = labels.select("id", "c", F.lit(0).cast("long").alias("w"))
    ties = ties.unionByName(own).groupBy("id", "c").agg(F.sum("w").alias("w"))
    rows = ties.join(degrees, "id").join(sums, "c").join(labels.withColumnRenamed("c", "a"), "id")
    rest = F.col("s") - F.when(F.col("c") == F.col("a"), F.col("k")).otherwise(0)
    rows = rows.select("id", "a", "c", (_wide("w") * F.lit(m).cast("decimal(19,0)") - _wide("k") * rest.cast("decimal(19,0)")).cast(_D).alias("x"))
    best = rows.groupBy("id", "a").agg(F.max(F.when(F.col("c") == F.col("a"), F.col("x"))).alias("stay"), F.max(F.when(F.col("c") != F.col("a"), F.col("x"))).alias("go"))
    there = rows.filter("c <> a").join(best.filter("go > stay"), ["id", "a"]).filter("x = go").groupBy("id", "a").agg(F.min("c").alias("b"), F.min(F.col("go") - F.col("stay")).alias("gain"))
    return there


def _disjoint(moves: DataFrame) -> DataFrame:
    """The moves that are the best (ties: the smallest id) of both communities that they touch."""
    place = F.struct(F.col("gain"), F.col("id"))
    ends = moves.select(F.explode(F.array("a", "b")).alias("c"), "gain", "id")
    top = ends.groupBy("c").agg(F.max("gain").alias("gain"))
    first = ends.join(top, ["c", "gain"]).groupBy("c").agg(F.min(place).alias("first"))
    one, two = first.select(F.col("c").alias("a"), F.col("first.id").alias("fa")), first.select(F.col("c").alias("b"), F.col("first.id").alias("fb"))
    return moves.join(one, "a").join(two, "b").filter("id = fa AND id = fb").select("id", "b")


def _moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return stored(labels.join(moves.select("id", F.col("b").alias("__b")), "id", "left").select("id", F.coalesce("__b", "c").alias("c")), "labels")


def _level(both: DataFrame, seed: int, least_gain: Fraction) -> tuple[DataFrame, Fraction]:
    """Labels (id, c) after local moves from every node on its own, and their modularity."""
    degrees = stored(both.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")), "degrees")
    labels = degrees.select("id", F.col("id").alias("c"))
    now = _inside(both, labels)
    for r in range(ROUNDS):
        moves = stored(_proposals(both, degrees, labels), "moves")
        if moves.isEmpty():
            break
        half = moves.filter(F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(2)) == 0)
        trial = _moved(labels, half)
        then = _inside(both, trial)
        if then <= now:
            trial = _moved(labels, _disjoint(moves))
            then = _inside(both, trial)
        gained, labels, now = then - now, trial, then
        if gained < least_gain:
            break
    return labels, now


def communities(nodes: DataFrame, edges: DataFrame, *, unit: int = UNIT, seed: int = SEED, least_gain: float | Fraction = LEAST_GAIN) -> DataFrame:
    """id, community (its smallest id) of every node; a node without edges is one by itself."""
    found, _ = levels(nodes, edges, unit=unit, seed=seed, least_gain=least_gain)
    return found


def levels(nodes: DataFrame, edges: DataFrame, *, unit: int = UNIT, seed: int = SEED, least_gain: float | Fraction = LEAST_GAIN) -> tuple[DataFrame, list[float]]:
    """The communities, and the modularity after each level (the first: every node by itself)."""
    ids = stored(nodes.select("id").distinct(), "ids")
    both = stored(undirected(edges, unit).join(ids.toDF("u"), "u", "left_semi").join(ids.toDF("v"), "v", "left_semi"), "undirected")
    labels = ids.select("id", F.col("id").alias("c"))
    values = [_inside(both, labels)]
    for k in range(LEVELS):
        local, value = _level(both, seed + 101 * k, Fraction(least_gain))
        if value <= values[-1]:
            break
        values.append(value)
        labels = stored(labels.join(local.toDF("c", "n"), "c", "left").select("id", F.coalesce("n", "c").alias("c")), "labels")
        a, b = local.toDF("u", "cu"), local.toDF("v", "cv")
        both = stored(both.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "contracted")
    least = labels.groupBy("c").agg(F.min("id").alias("community"))
    return labels.join(least, "c").select("id", "community"), [float(v) for v in values]
