"""Importance resampling of a corpus towards a target distribution of hashed word runs, by external sort-count.

The features of a text are all runs of 1 to ``MAX_WORDS`` consecutive words; a feature's bucket is a checksum of it modulo ``BUCKETS``. One pass over the
texts writes their buckets as packed 16-bit streams with the offsets of the documents, each stream with the run lengths of its sorted copy; the run lengths of all
streams add up to the counts of the corpus. The gains of the buckets (a ratio of smoothed shares in the target and in the corpus) then go to all
executors, ``BUCKETS`` numbers whatever the corpus, which read the streams again, gather gains and sum them by document with ``np.add.reduceat``.

A document's score is its mean gain plus Gumbel noise from a seeded hash of its id, so that the highest scores are a draw without replacement.
Scores are whole numbers within some 200,000 values: their histogram, counted by Spark, gives the last score that is drawn and where each score's ranks
begin, and only rows of equal score are ordered together. The noise spreads any corpus over the scores: less than 0.05 % of its rows have the same one.

Nulls and odd rows: a null text has no words; no features give weight 0. Rows with a null ``doc_id`` count in the corpus, have null score and are not drawn.
Rows of one ``doc_id`` have the same noise; of equal score and id, the greater n_features comes first. Repeated rows are all returned. An empty
corpus gives no rows, and an empty target leaves the gains of an empty one. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import ascii_words
from graphloom.llm.shared import stored, table

SEED = 2024
BUCKETS = 10_000
MAX_WORDS = 1
#: Documents of fewer words are not drawn.
MIN_WORDS = 20
#: Share of the documents that can be drawn, in percent.
PERCENT = 10
#: Features of a packed stream, about: a document is never cut in two.
STREAM = 1 << 20
#: Words whose buckets a task remembers.
REMEMBERED = 500_000

_WORDS = ascii_words.table(ascii_words.LETTERS + ascii_words.DIGITS)
STREAMS = "ids array<long>, words array<long>, ends array<long>, buckets binary, run_values array<int>, run_lengths array<long>"


class _Buckets(dict):
    """Bucket of a feature, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = crc32(feature) % self.buckets
        return found


def text_buckets(text: str | None, memory: _Buckets, max_words: int) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all features of a text, as 16-bit numbers."""
    n, parts, last = 0, [], []
    for own in ascii_words.words(text, _WORDS):
        n += len(own)
        parts.append(np.fromiter(map(memory.__getitem__, own), np.uint16, len(own)))
        run = last + own  # the words before the piece, for the runs that cross into it
        for k in range(2, max_words + 1):
            tail = run[max(0, len(last) - k + 1) :]
            runs = map(b" ".join, zip(*(tail[i:] for i in range(k)), strict=False))
            parts.append(np.fromiter(map(memory.__getitem__, runs), np.uint16))
        last = run[max(0, len(run) - max_words + 1) :]
    return n, np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _packed(ids: list, words: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    stream = np.concatenate(parts).astype("<u2")
    ends = np.cumsum([len(p) for p in parts])
    order = np.sort(stream)
    starts = np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else np.zeros(0, int)
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [one(ids, pa.int64()), one(words, pa.int64()), one(ends.tolist(), pa.int64()), pa.array([stream.tobytes()], pa.binary()), one(order[starts].tolist(), pa.int32()), one(np.diff(np.r_[starts, len(order)]).tolist(), pa.int64())],
        ["ids", "words", "ends", "buckets", "run_values", "run_lengths"],
    )


def streams(texts: DataFrame, *, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> DataFrame:
    """Packed bucket streams of ``texts`` (id: long, text), stored: a row holds some documents' ids, word counts, ends, buckets and run lengths."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets are packed in 16 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, ids, words, parts, size = _Buckets(buckets), [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                n, own = text_buckets(text.as_py(), memory, max_words)
                ids.append(i.as_py())
                words.append(n)
                parts.append(own)
                size += len(own) + 1
                if size >= STREAM:
                    yield _packed(ids, words, parts)
                    ids, words, parts, size = [], [], [], 0
        if ids:
            yield _packed(ids, words, parts)

    return stored(texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, STREAMS), "bucket-streams")


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all streams fall in each bucket: the sums of their run lengths."""
    runs = packed.select(F.explode(F.arrays_zip("run_values", "run_lengths")).alias("r")).groupBy("r.run_values").agg(F.sum("r.run_lengths").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for r in runs.collect():  # one row a bucket at most
        counts[r.run_values] = r.n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the corpus)), both smoothed by one, in doubles."""
    s, t, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(packed: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain; 0 without features)."""
    sent = packed.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c, i=i, b=batch: b.column(c)[i].values
                ends = at("ends").to_numpy()
                starts = np.r_[0, ends[:-1]]
                n = ends - starts
                own, some = np.zeros(len(ends), np.int64), n > 0
                if some.any():
                    # Documents without features have no place in the stream, so the next one's start ends the one before.
                    own[some] = np.add.reduceat(sent.value[np.frombuffer(batch.column("buckets")[i].as_py(), "<u2")], starts[some]) // n[some]
                yield pa.RecordBatch.from_arrays([at("ids"), at("words"), pa.array(n), pa.array(own)], ["doc_id", "n_words", "n_features", "weight"])

    return packed.select("ids", "words", "ends", "buckets").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """With score: weight plus Gumbel noise in thousandths from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long"))


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_words: int = MAX_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) of every row of ``docs`` (doc_id, text), towards the texts of ``target`` (text)."""
    size = {"buckets": buckets, "max_words": max_words}
    packed = streams(docs.select(F.col("doc_id").alias("id"), "text"), **size)
    wanted = streams(target.select(F.lit(0).alias("id"), "text"), **size)
    gains = bucket_gains(bucket_counts(packed, buckets), bucket_counts(wanted, buckets))
    rows = stored(scored(weights(packed, gains), seed), "scores")

    can = F.col("score").isNotNull() & (F.col("n_words") >= min_words)
    found = sorted(((r.score, r.n) for r in rows.filter(can).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # one row a score
    draw, before, starts = sum(n for _, n in found) * percent // 100, 0, []
    for score, n in found:
        if before >= draw:
            break
        starts.append((score, before))
        before += n
    none = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if not starts:
        return rows.select(*columns, none)
    last = starts[-1][0]
    places = F.broadcast(rows.sparkSession.createDataFrame(starts, "score long, before long"))  # at most one row a score
    first = can & (F.col("score") >= last)
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", F.desc("n_features"), "weight"))
    drawn = rows.filter(first).join(places, "score").select(*columns, rank.alias("rank"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(rows.filter(~F.coalesce(first, F.lit(False))).select(*columns, none))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
