"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

N-grams are of characters. Counts of the highest order come from all trusted documents, those of lower orders are
continuation counts; each order has three discounts from its counts of counts. Contexts, discounted probabilities and lower orders
meet in joins of tables that are dealt by n-gram or context, and the model is then joined to the distinct n-grams of all documents. The result, a
log-probability for each distinct n-gram, is bounded by the codes' combinations and the corpus: up to ``BROADCAST_ROWS`` rows go to
all executors and documents are summed up where they are; beyond that, documents' n-grams are joined to it by a shuffle.

A document is kept if its perplexity (of a character; characters that are spelled in bytes have several symbols), smoothed by ``PRIOR_CHARS`` characters of the middle perplexity so that a few characters don't
condemn a short text, is at most its language's threshold: the quantile ``HIGH`` of the perplexities of all trusted documents
in that language, each by a model of the other folds, which it gave no counts (of all languages for a language that has fewer than ``LEAST_TRUSTED`` of them).
Quantiles are exact up to ``1 / BINS`` of log-perplexity, as they are read from counts of bins of that width.

Nulls and odd rows: null and empty texts have perplexity null and are not kept. Labels with nulls are ignored, of repeated ones the
lowest quality counts. A null language is one of its own. Repeated rows are each judged. Without any trusted text nothing is known, thresholds are null and
all documents with text are kept. Columns other than doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import chars
from graphloom.llm.shared import scratch, small, stored, table

ORDER = 4
MIDDLE, HIGH = 0.5, 0.995
BINS = 1000
PRIOR_CHARS = 100
#: Trusted documents are dealt to so many folds by a hash of the id; for the thresholds each fold is measured by a model of all others (0: by the whole model).
FOLDS = 4
#: Up to so many ids of a fold's trusted documents are sent to all executors; more meet the documents by a shuffle.
TRUSTED_ROWS = 1_000_000
LEAST_TRUSTED = 30
BROADCAST_ROWS = 2_000_000


def _mask(k: int) -> int:
    return (1 << (chars.BITS * k)) - 1


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of a table with column ``a``, from its counts of counts."""
    row = counts.agg(*[F.sum(F.when(F.col("a") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{i}"] or 0 for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    clip = lambda d, most: min(max(d, 0.1), most)  # noqa: E731  small tables can give discounts out of range
    return (clip(1 - 2 * y * n2 / n1, 0.9) if n1 else 0.5, clip(2 - 3 * y * n3 / n2, 1.9) if n2 else 1.0, clip(3 - 4 * y * n4 / n3, 2.9) if n3 else 1.5)


def train(counts: DataFrame, *, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (key, p) of seen n-grams, interpolated, and (context, g), the weight of the lower order.

    ``counts``: key, n of the highest order's n-grams.
    """
    tables = [stored(counts.select("key", F.col("n").alias("a")), "ngrams")]
    for k in range(order - 1, 0, -1):  # continuation counts
        tables.append(stored(tables[-1].groupBy(F.col("key").bitwiseAND(_mask(k)).alias("key")).agg(F.count(F.lit(1)).alias("a")), "ngrams"))
    model: list[tuple[DataFrame, DataFrame]] = []
    for k, own in enumerate(reversed(tables), 1):
        d1, d2, d3 = discounts(own)
        rows = own.withColumn("context", F.shiftright("key", chars.BITS)).withColumn("d", F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3))
        contexts = stored(rows.groupBy("context").agg(F.sum("a").alias("total"), (F.sum("d") / F.sum("a")).alias("g")), "contexts")
        rows = rows.join(contexts, "context").withColumn("own", (F.col("a") - F.col("d")) / F.col("total"))
        if k == 1:
            rows = rows.withColumn("lower", F.lit(1.0 / chars.CODES))
        else:
            lower = model[-1][0].select(F.col("key").alias("tail"), F.col("p").alias("lower"))  # every tail of an n-gram is one of the lower order
            rows = rows.withColumn("tail", F.col("key").bitwiseAND(_mask(k - 1))).join(lower, "tail")
        model.append((stored(rows.select("key", (F.col("own") + F.col("g") * F.col("lower")).alias("p")), "probabilities"), contexts.select("context", "g")))
    return model


def _added(counts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, counts).groupBy("key").agg(F.sum("n").alias("n"))


def log_probabilities(keys: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """key, logp of any n-grams of the highest order (column key, distinct) by joins with each order."""
    now = keys.withColumn("p", F.lit(1.0 / chars.CODES))
    for k, (seen, contexts) in enumerate(model, 1):
        tail = F.col("key").bitwiseAND(_mask(k))
        now = now.withColumn("tail", tail).join(seen.select(F.col("key").alias("tail"), F.col("p").alias("own")), "tail", "left")
        now = now.withColumn("context", F.shiftright("tail", chars.BITS)).join(contexts, "context", "left")
        # a seen n-gram has its probability, an unseen one the context's share of the lower order's, all of it if the context is new
        now = now.select("key", F.coalesce("own", F.coalesce("g", F.lit(1.0)) * F.col("p")).alias("p"))
    return now.select("key", F.log("p").alias("logp"))


def _summed(letters: chars.Alphabet, order: int, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (keys, logp) = letters.table(), known.value
        for batch in batches:
            at = 0
            for group in chars.groups(batch.column("text").to_pylist()):
                own, sizes = chars.windows(group, letters, codes, order - 1, 0)
                total = np.zeros(len(group))
                if len(own):
                    place, unique = pd.factorize(own)
                    total = chars.summed_by_text(logp[np.searchsorted(keys, unique)][place], sizes)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(group)), batch.column("lang").slice(at, len(group)), pa.array([len(x) for x in group], pa.int64()), pa.array(total)], ["doc_id", "lang", "n", "total"])
                at += len(group)

    return run


def _of_each(letters: chars.Alphabet, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = letters.table()
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                place, unique = pd.factorize(chars.windows([text or ""], letters, codes, order - 1, 0)[0])
                counts = np.bincount(place, minlength=len(unique))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("row_id")[i].as_py()] * len(unique), pa.int64()), pa.array(unique, pa.int64()), pa.array(counts, pa.int64())], ["row_id", "key", "n"])

    return run


def perplexities(docs: DataFrame, letters: chars.Alphabet, scored: DataFrame, *, order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, lang, n (characters), total (log-probability) of every row. ``scored``: key, logp of all n-grams of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    spark = docs.sparkSession
    if scored.count() <= broadcast_rows:
        found = scored.orderBy("key").toArrow()
        known = spark.sparkContext.broadcast((found["key"].to_numpy(), found["logp"].to_numpy()))
        return rows.mapInArrow(_summed(letters, order, known), "doc_id long, lang string, n long, total double")
    path = scratch(spark, "rows")
    rows.withColumn("row_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sums = rows.select("row_id", "text").mapInArrow(_of_each(letters, order), "row_id long, key long, n long").join(scored, "key").groupBy("row_id").agg(F.sum(F.col("n") * F.col("logp")).alias("total"))
    return rows.select("row_id", "doc_id", "lang", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n")).join(sums, "row_id", "left").select("doc_id", "lang", "n", F.coalesce("total", F.lit(0.0)).alias("total"))


def sampled(trusted: DataFrame, rows: int) -> DataFrame:
    """trusted_id of about ``rows`` rows of ``trusted`` (trusted_id, lang) at most: all of small languages, equally many of each of the others."""
    sizes = stored(trusted.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("k")), "languages")
    most, left, langs = None, rows, sizes.count()
    if (sizes.agg(F.sum("k")).first()[0] or 0) <= rows:
        return trusted.select("trusted_id")
    for k, n in sorted(map(tuple, sizes.groupBy("k").count().collect())):  # water-filling
        most = left / langs
        if k > most:
            break
        left, langs = left - k * n, langs - n
    chance = F.pmod(F.xxhash64(F.lit("sample"), "trusted_id"), F.lit(1 << 30)) / (1 << 30)
    return trusted.join(F.broadcast(sizes), F.expr("lang <=> l")).filter(chance < F.lit(float(most)) / F.col("k")).select("trusted_id")


def classify(docs: DataFrame, labels: DataFrame, *, order: int = ORDER, folds: int = FOLDS, trusted_docs: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, lang, n_chars, log_perplexity, threshold, kept of every row of ``docs`` (doc_id, text, lang).

    ``labels``: doc_id, quality (1 trusted). ``trusted_docs``: None, or about how many of the trusted documents give counts.
    """
    trusted = labels.select(F.col("doc_id").cast("long").alias("trusted_id"), "quality").na.drop().groupBy("trusted_id").agg(F.min("quality").alias("q")).filter("q > 0").select("trusted_id")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    trusted = stored(own.select(F.col("doc_id").alias("trusted_id"), "lang").join(trusted, "trusted_id").groupBy("trusted_id").agg(F.min("lang").alias("lang")), "trusted")
    counting = trusted if trusted_docs is None else trusted.join(sampled(trusted, trusted_docs), "trusted_id")
    counting = stored(counting.select("trusted_id", F.pmod(F.xxhash64("trusted_id"), F.lit(max(1, folds))).alias("fold")), "counting")
    used = sorted(r.fold for r in counting.select("fold").distinct().collect()) or [0]
    letters = chars.alphabet(own)
    texts = {f: own.join(small(counting.filter(F.col("fold") == f), TRUSTED_ROWS), F.col("doc_id") == F.col("trusted_id"), "left_semi") for f in used}
    counts = {f: stored(chars.window_counts(texts[f], letters, order - 1, 0), "fold-counts") for f in used}
    model = train(_added([counts[f] for f in used]), order=order)
    keys = chars.window_counts(own, letters, order - 1, 0).select("key")

    def measured(texts: DataFrame, keys: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
        scored = stored(log_probabilities(keys, model), "scored-ngrams")
        return stored(perplexities(texts, letters, scored, order=order, broadcast_rows=broadcast_rows).withColumn("lp", F.expr("IF(n > 0, -total / n, NULL)")), "perplexities")

    rows = measured(own, keys, model)
    if len(used) > 1:  # each fold by a model of the others; those that give no counts at all by the whole model
        rest = trusted.join(counting, "trusted_id", "left_anti")
        held_out = [measured(texts[f], counts[f].select("key"), train(_added([counts[g] for g in used if g != f]), order=order)) for f in used]
        of_trusted = reduce(DataFrame.union, held_out, rows.join(rest, F.col("doc_id") == F.col("trusted_id"), "left_semi"))
    else:
        of_trusted = rows.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    of_trusted = of_trusted.filter("lp IS NOT NULL")
    bins = stored(of_trusted.groupBy(F.col("lang").alias("l"), F.floor(F.col("lp") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("k")), "perplexity-bins")
    by_lang = quantiles(bins, ["l"]).filter(F.col("k") >= LEAST_TRUSTED).select("l", F.col("q").alias("own"))
    overall = quantiles(bins.groupBy("bin").agg(F.sum("k").alias("k")), []).select(F.col("q").alias("overall"))
    both = rows.join(by_lang, F.expr("lang <=> l"), "left").crossJoin(F.broadcast(overall))  # one row
    both = both.withColumn("q", F.coalesce("own", "overall")).withColumn("threshold", F.col("q.high"))
    smooth = f"(n * lp + {PRIOR_CHARS} * q.middle) / (n + {PRIOR_CHARS})"
    return both.select("doc_id", "lang", F.col("n").alias("n_chars"), F.col("lp").alias("log_perplexity"), "threshold", F.expr(f"lp IS NOT NULL AND (threshold IS NULL OR {smooth} <= threshold)").alias("kept"))


def quantiles(bins: DataFrame, by: list[str]) -> DataFrame:
    """by, k (all rows), q (middle, high: upper ends of the bins that hold the quantiles) of counts k of bins."""
    parts = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each bin that occurs
    upto = bins.withColumn("upto", F.sum("k").over(parts.orderBy("bin"))).withColumn("whole", F.sum("k").over(parts))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("whole"), (F.col("bin") + 1) / BINS))
    return upto.groupBy(*by).agg(F.max("whole").alias("k"), F.struct(at(MIDDLE).alias("middle"), at(HIGH).alias("high")).alias("q"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
