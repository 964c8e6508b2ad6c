"""Drift between versions, similarity of role distributions and matrices, provenance statistics, observability of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.storage import stored


def count_drift(a: str | Column, b: str | Column) -> Column:
    """|a - b| over the greater; 0.5 if exactly one is 0, 0 if both are."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when((a == 0) & (b == 0), 0.0).when((a == 0) | (b == 0), 0.5).otherwise(F.abs(a - b) / F.greatest(a, b))


def key_drift(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row: added, removed, changed, kept keys of two tables (key, value)."""
    both = old.select(F.col(key).alias("k"), F.col(value).alias("a"), F.lit(1).alias("ina")).join(new.select(F.col(key).alias("k"), F.col(value).alias("b"), F.lit(1).alias("inb")), "k", "full")
    n = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))
    here = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.agg(n(F.col("ina").isNull()).alias("added"), n(F.col("inb").isNull()).alias("removed"), n(here & ~same).alias("changed"), n(here & same).alias("kept"))


def distributions(a: DataFrame, b: DataFrame) -> DataFrame:
    """role, a, b: counts of two tables (role, n) side by side, 0 where missing."""
    return a.select("role", F.col("n").alias("a")).join(b.select("role", F.col("n").alias("b")), "role", "full").na.fill(0, ["a", "b"])


def js_similarity(both: DataFrame) -> DataFrame:
    """One row: 1 less the Jensen-Shannon divergence (base 2) of the shares of a and b; 0 if a side is empty."""
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    rows = both.crossJoin(F.broadcast(total)).withColumn("p", F.when(F.col("ta") > 0, F.col("a") / F.col("ta")).otherwise(0.0)).withColumn("q", F.when(F.col("tb") > 0, F.col("b") / F.col("tb")).otherwise(0.0))  # one row
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    out = rows.agg(F.sum(term(F.col("p")) + term(F.col("q"))).alias("d"), F.max("ta").alias("ta"), F.max("tb").alias("tb"))
    return out.select(F.when((F.coalesce("ta", F.lit(0)) <= 0) | (F.coalesce("tb", F.lit(0)) <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d") / 2))).alias("similarity"))


def role_preservation(both: DataFrame) -> DataFrame:
    """One row: the mean over roles of the smaller count over the greater (1 without roles), and the ratio of sums of both (0 if a side is empty)."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    out = both.filter("a > 0 OR b > 0").agg(F.avg(lo / hi).alias("mean"), F.sum(lo).alias("lo"), F.sum(hi).alias("hi"))
    return out.select(F.coalesce("mean", F.lit(1.0)).alias("preservation"), F.when(F.coalesce("hi", F.lit(0)) > 0, F.col("lo") / F.col("hi")).otherwise(0.0).alias("overlap"))


def matrix_similarity(a: DataFrame, b: DataFrame, keys: list[str], value: str = "p", *, eps: float = 1e-12) -> DataFrame:
    """One row: 1 less the Frobenius norm of the difference over the sum of both norms (missing cells are 0)."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys, "full").na.fill(0.0, ["x", "y"])
    norm = lambda c: F.sqrt(F.sum(c * c))
    out = both.agg(norm(F.col("x") - F.col("y")).alias("d"), norm(F.col("x")).alias("nx"), norm(F.col("y")).alias("ny"))
    return out.select((1 - F.coalesce("d", F.lit(0.0)) / (F.coalesce("nx", F.lit(0.0)) + F.coalesce("ny", F.lit(0.0)) + eps)).alias("similarity"))


def multiset_similarity() -> Column:
    """Of columns a and b: 1 less the sum of differences over the sum of counts (an aggregate)."""
    return 1 - F.sum(F.abs(F.col("a") - F.col("b"))) / F.greatest(F.sum(F.col("a") + F.col("b")), F.lit(1))


def provenance_confidence(records: DataFrame) -> DataFrame:
    """target_id, confidence: the mean of its records' confidence and 0.02 for each kind of evidence, up to 0.1; at most 1."""
    return records.groupBy("target_id").agg(F.least(F.lit(1.0), F.avg("confidence") + F.least(F.lit(0.1), 0.02 * F.count_distinct("evidence_type"))).alias("confidence"))


def provenance_stats(records: DataFrame) -> DataFrame:
    """dimension, value, n, mean confidence by target type, by kind of evidence, by method, and in all."""
    out = records.groupingSets([["target_type"], ["evidence_type"], ["method"], []], "target_type", "evidence_type", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"))
    dimension = F.when(F.col("target_type").isNotNull(), "target_type").when(F.col("evidence_type").isNotNull(), "evidence_type").when(F.col("method").isNotNull(), "method").otherwise("all")
    return out.select(dimension.alias("dimension"), F.coalesce("target_type", "evidence_type", "method").alias("value"), "n", "mean")


def share_of(elements: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: the share of elements (id) that stand in hits (id); 0 without elements. Gives observability, controllability and semantic coverage."""
    both = elements.select("id").distinct().join(hits.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("share"))


def rank_percentiles(df: DataFrame, by: str, value: str, percents: list[int], *, parts: int = 64) -> DataFrame:
    """by, percent, value: the value at place ``int(n * percent / 100)`` of each group in ascending order (the last at most); null values are left out.

    Counts by stretches of values (between ``parts`` quantiles of all) say in which stretch a place lies; only the values of those stretches are put in order, equal ones as one row. So
    no task sorts a group.
    """
    rows = df.select(F.col(by).alias("__by"), F.col(value).alias("__v")).filter("__v IS NOT NULL")
    row = rows.agg(F.percentile_approx("__v", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts")).first()
    cuts = sorted(set(row.cuts or []))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("__v"))) if cuts else F.lit(0)
    counted = stored(rows.groupBy("__by", "__v").agg(F.count(F.lit(1)).alias("k")).withColumn("part", at), "counted-values")
    sums = counted.groupBy("__by", "part").agg(F.sum("k").alias("k"))
    whole = Window.partitionBy("__by")
    sums = sums.select("__by", "part", "k", (F.sum("k").over(whole.orderBy("part")) - F.col("k")).alias("before"), F.sum("k").over(whole).alias("n"))
    want = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1).alias("at")) for p in percents])).alias("w")
    places = stored(sums.select("__by", "part", "k", "before", want).filter("w.at >= before AND w.at < before + k").select("__by", "part", "w.percent", (F.col("w.at") - F.col("before")).alias("at")), "places")
    near = counted.join(places.select("__by", "part").distinct(), ["__by", "part"], "left_semi")
    upto = F.sum("k").over(Window.partitionBy("__by", "part").orderBy("__v"))
    found = near.withColumn("upto", upto).join(places, ["__by", "part"]).filter("at < upto AND at >= upto - k")
    return found.select(F.col("__by").alias(by), "percent", F.col("__v").alias(value))

