"""Quality rules by line sequence labelling.

Each line that has a word is described by a few numbers; a linear-chain conditional random field with the labels content and
boilerplate is decoded over a document's lines by Viterbi, and the share of the lines' characters that are content
decides retention, after two base rules on word counts and repeated five-word windows.

The field is trained here, in numpy, on a bounded sample of labelled documents (``sample`` documents of at most ``sample_lines`` lines).
Lines are labelled one by one: a line is boilerplate if its document is of low quality, or if it stands, digits aside, in ``RECUR`` documents of the
sample or more (copies, most lines of which recur, are left out); all others are content. To the documents as they are come mixed ones: each good document with runs
of boilerplate lines put in at its start, within it or at its end, so that the chain sees where content begins and ends. Where there are no labels of both kinds, ``PRIOR`` is used.

Nulls and odd rows: a null text has no words and fails the base rules, like an empty one. Null, repeated and
unknown labels: labels with nulls are ignored, of repeated ones the highest counts. Repeated rows are each judged. Empty
tables give no rows. ``keep_content`` passes on all columns of its input, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import table

SAMPLE = 3000
SAMPLE_LINES = 200
#: Documents of the sample in which a boilerplate line stands.
RECUR = 3
#: Weights of good, low-quality and mixed documents in the training; good ones weigh more, as a lost one costs more than junk that stays.
PARTS = (10, 1, 2)
#: Lines of a run that is put into a good document.
RUN_LINES = (1, 4)
MIN_WORDS = 10
MIN_CONTENT = 0.5
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("bias", "short", "log_words", "symbol_words", "upper_words", "repeated_words", "shouts", "cells", "no_stop", "digits", "seen_before")
#: Emission weights for content, then transitions [from boilerplate, from content] x [to boilerplate, to content].
PRIOR = ([1.5, -0.3, 0.2, -6.0, -4.0, -3.0, -4.0, -6.0, -0.3, -1.0, -0.5], [[0.7, -0.7], [-0.7, 0.7]])

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
_LAST = frozenset(b"#*$%&|<>=_~^")


def line_features(words: list[bytes], seen: bool) -> list[float]:
    n = len(words)
    last = words[-1][-1]
    return [
        1.0,
        1.0 if n < 4 else 0.0,
        log2(n) / 5,
        sum(w[-1] in _LAST for w in words) / n,
        sum(map(bytes.isupper, words)) / n,
        1 - len(set(words)) / n,
        sum(w.endswith(b"!!") for w in words) / n,
        words.count(b"|") / n,
        0.0 if last in b".!?" else 1.0,
        sum(map(bytes.isdigit, words)) / n,
        1.0 if seen else 0.0,
    ]


def repeated_window_words(words: list[bytes]) -> int:
    """Words in five-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    count, end, total = Counter(windows), 0, 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            total += i + 5 - max(i, end)
            end = i + 5
    return total


def measure(text: str | None) -> tuple[tuple, list[list[float]], list[int]]:
    """Base counts of a text, and the features and characters of its lines with a word."""
    text = text or ""
    words: list[bytes] = []
    rows: list[list[float]] = []
    chars: list[int] = []
    seen: set[bytes] = set()
    dup = 0
    for line in text.encode("utf-8").split(b"\n"):
        own = line.split()
        if own:
            again = line in seen
            dup += again
            seen.add(line)
            rows.append(line_features(own, again))
            chars.append(len(line))
            words += own
    n = len(words)
    repeat = repeated_window_words(words)
    base = (n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeat, n < MIN_WORDS or 100 * repeat > 20 * n)
    return base, rows, chars


def viterbi(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Labels (1 content) of the best path; ``emission`` is content's score at each line, boilerplate's is 0. Ties: boilerplate."""
    (bb, bc), (cb, cc) = transition.tolist()
    b, c, back = 0.0, float(emission[0]), []
    for e in emission[1:].tolist():
        from_b, from_c = b + bb, c + cb
        to_b, to_c = b + bc, c + cc
        back.append((from_c > from_b, to_c > to_b))
        b, c = max(from_b, from_c), e + max(to_b, to_c)
    label = int(c > b)
    out = [label]
    for pair in reversed(back):
        label = int(pair[label])
        out.append(label)
    return np.asarray(out[::-1], np.int8)


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log-likelihood of the labels, and its gradient.

    ``x``: lines x documents x features, longest documents first; ``y``: lines x documents; ``size`` and ``share``: lines and weight of each document.
    """
    longest, n, f = x.shape
    live = [int((size > t).sum()) for t in range(longest)]  # documents with a line t come first
    w, trans, each = theta[:f], theta[f:].reshape(2, 2), np.arange(n)
    e = np.zeros((longest, n, 2))
    e[:, :, 1] = x @ w
    alpha, beta = e.copy(), np.zeros((longest, n, 2))
    for t in range(1, longest):
        k = live[t]
        alpha[t, :k] += np.logaddexp(alpha[t - 1, :k, :1] + trans[0], alpha[t - 1, :k, 1:] + trans[1])
    for t in range(longest - 2, -1, -1):
        k = live[t + 1]
        after = beta[t + 1, :k] + e[t + 1, :k]
        beta[t, :k] = np.logaddexp(after[:, :1] + trans[:, 0], after[:, 1:] + trans[:, 1])
    z = np.logaddexp(*alpha[size - 1, each].T)
    told, grad = -z, np.zeros_like(theta)
    for t in range(longest):
        k = live[t]
        p = np.exp(alpha[t, :k, 1] + beta[t, :k, 1] - z[:k])
        told[:k] += e[t, each[:k], y[t, :k]]
        grad[:f] += ((y[t, :k] - p) * share[:k]) @ x[t, :k]
        if t:
            joint = -np.exp(alpha[t - 1, :k, :, None] + trans + (beta[t, :k] + e[t, :k])[:, None, :] - z[:k, None, None])
            joint[each[:k], y[t - 1, :k], y[t, :k]] += 1
            told[:k] += trans[y[t - 1, :k], y[t, :k]]
            grad[f:] += (joint * share[:k, None, None]).sum(0).ravel()
    return float(told @ share), grad


def train(docs: list[tuple[np.ndarray, np.ndarray, float]], *, steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> tuple[list[float], list[list[float]]]:
    """Fits emission and transition weights by gradient ascent (Adam) on the exact log-likelihood.

    ``docs``: line features (lines x features), labels of the lines and weight of each document.
    """
    docs = sorted((d for d in docs if len(d[0])), key=lambda d: -len(d[0]))
    n, longest, f = len(docs), len(docs[0][0]), docs[0][0].shape[1]
    x, y, size = np.zeros((longest, n, f)), np.zeros((longest, n), np.int64), np.array([len(d[0]) for d in docs])
    for i, (rows, labels, _) in enumerate(docs):
        x[: len(rows), i], y[: len(rows), i] = rows, labels
    share = np.array([d[2] for d in docs]) / size  # documents count alike, however long
    share /= (share * size).sum()
    theta = np.zeros(f + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = likelihood(theta, x, y, size, share)[1] - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:f].tolist(), theta[f:].reshape(2, 2).tolist()


def line_labels(sample: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The documents to train on, with labels of their lines and weights.

    ``sample``: quality, features of the lines and hashes of the lines of each document, in an order that does not depend on tasks.
    """
    sample = list({hashes.tobytes(): (q, rows, hashes) for q, rows, hashes in sample if len(rows)}.values())

    def recurring(docs: list) -> set:
        count = Counter(h for _, _, hashes in docs for h in set(hashes.tolist()))
        return {h for h, n in count.items() if n >= RECUR}

    first = recurring(sample)
    sample = [d for d in sample if 2 * sum(h in first for h in d[2].tolist()) <= len(d[2]) or len(d[2]) < 3]
    again = recurring(sample)
    good, junk, runs = [], [], []
    for q, rows, hashes in sample:
        labels = np.array([int(q > 0 and h not in again) for h in hashes.tolist()], np.int64)
        (good if q > 0 else junk).append((rows, labels))
        if q <= 0:
            runs.append(rows)
    if not good or not junk:
        return []
    rng, mixed = np.random.default_rng(len(sample)), []
    for rows, labels in good:
        for place in (0, len(rows), int(rng.integers(0, len(rows) + 1)))[int(rng.integers(0, 3)) :]:
            own = runs[int(rng.integers(0, len(runs)))]
            at, n = int(rng.integers(0, len(own))), int(rng.integers(*RUN_LINES, endpoint=True))
            run = own[at : at + n]
            place = min(place, len(rows))
            rows = np.concatenate((rows[:place], run, rows[place:]))
            labels = np.concatenate((labels[:place], np.zeros(len(run), np.int64), labels[place:]))
        mixed.append((rows, labels))
    return [(rows, labels, w / len(part)) for part, w in zip((good, junk, mixed), PARTS) for rows, labels in part]


_DIGITS = re.compile(rb"[0-9]+")


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for batch in batches:
        rows, hashes = [], []
        for text in batch.column("text").to_pylist():
            rows.append(np.asarray(measure(text)[1], np.float64).ravel().tolist())
            lines = [b" ".join(line.split()) for line in (text or "").encode().split(b"\n")]
            hashes.append([xxh64_intdigest(_DIGITS.sub(b"0", line)) >> 1 for line in lines if line])
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.list_(pa.float64())), pa.array(hashes, pa.list_(pa.int64()))], ["quality", "rows", "hashes"])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> tuple[list[float], list[list[float]]]:
    """The model of a bounded sample: the ``sample`` labelled documents that come first by a hash of their id.

    Of the rows of these ids the first ``2 * sample`` by a hash of id and text are taken.
    """
    told = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).na.drop().groupBy("id").agg(F.max("quality").alias("quality"))
    told = told.orderBy(F.xxhash64("id"), "id").limit(sample)
    both = docs.select("doc_id", "text").join(F.broadcast(told), F.col("doc_id") == F.col("id")).select("quality", "text", F.xxhash64("id", "text").alias("order"))
    both = both.filter(F.length("text") - F.length(F.translate("text", "\n", "")) < sample_lines)
    rows = both.orderBy("order").limit(2 * sample).select("quality", "text").mapInArrow(_sampled, "quality int, rows array<double>, hashes array<long>").collect()
    found = line_labels([(int(r.quality), np.asarray(r.rows).reshape(-1, len(FEATURES)), np.asarray(r.hashes, np.int64)) for r in rows])
    return train(found) if found else PRIOR


def _judge(texts: list, model: tuple, min_content: float) -> list[tuple]:
    weights, transition = np.asarray(model[0]), np.asarray(model[1])
    out = []
    for text in texts:
        base, rows, chars = measure(text)
        share = 0.0
        if rows:
            labels = viterbi(np.asarray(rows) @ weights, transition)
            share = float(np.dot(labels, chars) / sum(chars))
        out.append((*base, share, not base[5] and share >= min_content))
    return out


def _stats(model: tuple, min_content: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STATS.split(", ")]
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        for batch in batches:
            columns = list(zip(*_judge(batch.column("text").to_pylist(), model, min_content))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["doc_id", *names])

    return run


def judge(docs: DataFrame, model: tuple, *, min_content: float = MIN_CONTENT) -> DataFrame:
    """doc_id, the base counts, content_share and kept of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stats(model, min_content), f"doc_id long, {STATS}")


def _kept(model: tuple, min_content: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([r[-1] for r in _judge(batch.column("text").to_pylist(), model, min_content)], pa.bool_()))

    return run


def keep_content(docs: DataFrame, model: tuple, *, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return docs.mapInArrow(_kept(model, min_content), docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
