"""Language-model scores by masked pseudo-likelihood.

A bidirectional window network predicts every symbol (a character, or a byte of a rare one) from the ``SIDE`` symbols on either side: embeddings of the
neighbours, one hidden layer, a softmax over the alphabet. A document's score is the sum over its symbols of the log-probability of each
given both sides.

Windows are counted over all documents, and all of them, with their counts, enter the training, which is numpy in the executors: the distinct windows are
dealt to shards (one for each ``SHARD_WINDOWS`` of them, ``SHARDS`` at most). In each round every shard starts from the same weights,
takes a step of Adam for each ``BATCH`` of its windows, and the shards' weights are averaged by their counts. A window weighs as often as it occurs: it is
visited once for every started mean count, and no visit weighs more than the mean. So the steps grow with the corpus. Small corpora are passed
over until each round has ``LEAST_STEPS`` steps.

In scoring, each distinct window of a group of texts goes through the network once.

Nulls and odd rows: null and empty texts have no symbols and score 0. Repeated rows are each scored. An empty table gives no
rows (and a network of random weights). Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chars
from graphloom.llm.shared import stored, table

SIDE = 2
EMBEDDING, HIDDEN = 16, 48
ROUNDS, BATCH, RATE = 3, 256, 0.01
#: Distinct windows of a shard, about, unless that makes more than SHARDS shards; each sends its weights to the driver once a round.
SHARD_WINDOWS, SHARDS = 50_000, 64
LEAST_STEPS = 300
NAMES = ("e", "w1", "b1", "w2", "b2")


def shapes(size: int) -> dict[str, tuple[int, ...]]:
    return {"e": (2 * SIDE, size, EMBEDDING), "w1": (2 * SIDE * EMBEDDING, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, size), "b2": (size,)}


def initial(size: int, seed: int = 5) -> dict[str, np.ndarray]:
    """Random weights for an alphabet of ``size`` codes."""
    rng = np.random.default_rng(seed)
    scale = {"e": 0.3, "w1": 0.2, "b1": 0.0, "w2": 0.1, "b2": 0.0}
    return {k: rng.normal(0, 1, shape).astype(np.float32) * np.float32(scale[k]) for k, shape in shapes(size).items()}


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def unpacked_weights(line: np.ndarray, size: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in shapes(size).items():
        n = int(np.prod(shape))
        out[k] = np.asarray(line[at : at + n], np.float32).reshape(shape).copy()
        at += n
    return out


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the neighbours (windows x 2 SIDE), and of the middle."""
    codes = np.stack([(keys >> (chars.BITS * k)) & (chars.CODES - 1) for k in range(2 * SIDE, -1, -1)], axis=1)
    return np.delete(codes, SIDE, axis=1), codes[:, SIDE]


def gradient(p: dict[str, np.ndarray], keys: np.ndarray, weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean cross-entropy of the middles given their neighbours, and its gradient."""
    x, y = unpacked(keys)
    n, side = len(y), np.arange(2 * SIDE)
    w = (weights / weights.sum()).astype(p["w1"].dtype)
    emb = p["e"][side, x].reshape(n, -1)
    h = np.tanh(emb @ p["w1"] + p["b1"])
    z = h @ p["w2"] + p["b2"]
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    loss = float(-(w * np.log(z[np.arange(n), y])).sum())
    z[np.arange(n), y] -= 1
    z *= w[:, None]
    dh = (z @ p["w2"].T) * (1 - h * h)
    de = (dh @ p["w1"].T).reshape(n, 2 * SIDE, -1)
    g = {"w2": h.T @ z, "b2": z.sum(0), "w1": emb.T @ dh, "b1": dh.sum(0), "e": np.zeros_like(p["e"])}
    np.add.at(g["e"], (side, x), de)
    return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def take(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.step += 1
        for k, g in gradient(self.p, keys, weights)[1].items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-8)


def _trained(start: np.ndarray, size: int, rate: float, mean: float, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam, total, rest = Adam(unpacked_weights(start, size), rate), 0.0, (np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
            visits = np.ceil(n / mean).astype(np.int64)
            rng = np.random.default_rng(int(key[0]))
            for _ in range(passes):
                # the visits of one Arrow batch, in random order; what fills no step waits for the next
                order = rng.permutation(np.repeat(np.arange(len(key)), visits))
                keys, weights = np.concatenate((rest[0], key[order])), np.concatenate((rest[1], (n / visits)[order]))
                for at in range(0, len(keys) - BATCH + 1, BATCH):
                    adam.take(keys[at : at + BATCH], weights[at : at + BATCH])
                left = len(keys) // BATCH * BATCH
                rest = keys[left:], weights[left:]
            total += n.sum()
        if len(rest[0]):
            adam.take(*rest)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([packed(adam.p).astype("<f4").tobytes()])], ["total", "weights"])

    return run


def train(counts: DataFrame, size: int, *, rounds: int = ROUNDS, least_steps: int = LEAST_STEPS) -> dict[str, np.ndarray]:
    """The network for all windows of ``counts`` (key, n; stored) over an alphabet of ``size`` codes."""
    row = counts.agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total")).first()
    weights = packed(initial(size))
    if not row.distinct:
        return unpacked_weights(weights, size)
    shards = min(SHARDS, max(1, row.distinct // SHARD_WINDOWS))
    passes = max(1, ceil(least_steps * BATCH * shards / (2 * row.distinct)))
    parts = counts.repartition(shards, "key").sortWithinPartitions(F.xxhash64("key"), "key")  # one order whenever a task is run
    for k in range(rounds):
        found = parts.mapInArrow(_trained(weights, size, RATE * (1 - k / rounds), row.total / row.distinct, passes), "total double, weights binary").collect()  # SHARDS rows at most
        found = sorted(((r.total, bytes(r.weights)) for r in found), reverse=True)
        weights = sum(t * np.frombuffer(w, "<f4").astype(np.float64) for t, w in found) / sum(t for t, _ in found)
    return unpacked_weights(weights, size)


def log_probabilities(p: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Log-probability of each window's middle given both sides."""
    out = np.empty(len(keys))
    for a in range(0, len(keys), 20_000):
        around, middle = unpacked(keys[a : a + 20_000])
        h = np.tanh(p["e"][np.arange(2 * SIDE), around].reshape(len(middle), -1) @ p["w1"] + p["b1"])
        z = h @ p["w2"] + p["b2"]
        top = z.max(1)
        out[a : a + 20_000] = z[np.arange(len(middle)), middle] - top - np.log(np.exp(z - top[:, None]).sum(1))
    return out


def _score(letters: chars.Alphabet, net: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = letters.table()
        for batch in batches:
            at = 0
            for group in chars.groups(batch.column("text").to_pylist()):
                keys, sizes = chars.windows(group, letters, codes, SIDE, SIDE)
                place, unique = pd.factorize(keys)
                total = chars.summed_by_text(log_probabilities(net, unique)[place], sizes) if len(keys) else np.zeros(len(group))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(group)), pa.array(sizes), pa.array(total), pa.array(total / np.maximum(sizes, 1))], ["doc_id", "n_tokens", "pll", "pll_per_token"])
                at += len(group)

    return run


def fit(docs: DataFrame, **parameters) -> tuple[chars.Alphabet, dict[str, np.ndarray]]:
    """The alphabet and the trained network for ``docs`` (text)."""
    letters = chars.alphabet(docs)
    counts = stored(chars.window_counts(docs, letters, SIDE, SIDE), "windows")
    return letters, train(counts, letters.size, **parameters)


def score(docs: DataFrame, model: tuple[chars.Alphabet, dict[str, np.ndarray]]) -> DataFrame:
    """doc_id, n_tokens, pll (sum of log-probabilities), pll_per_token of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_score(*model), "doc_id long, n_tokens long, pll double, pll_per_token double")


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
