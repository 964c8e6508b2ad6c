import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from graphloom.llm import ascii_words, importance_resampling
from graphloom.llm.importance_resampling import op12_importance_resampling, resampled
from graphloom.llm.shared import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, percent=10, min_words=20, buckets=10_000, max_words=1, seed=2024):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return len(w), [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, max_words + 1) for i in range(len(w) - k + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    ns, nt = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * (ns + buckets) / (float(s[b] + 1) * (nt + buckets))))
    out = []
    for i, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score, n))
    can = sorted((-r[3], r[0], -r[1], r[2], k) for k, r in enumerate(out) if r[3] is not None and r[4] >= min_words)
    rank = {x[-1]: j for j, x in enumerate(can[: len(can) * percent // 100], 1)}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(out)), key=repr)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", 0.5) for i, t in rows], "doc_id long, text string, weight long, rank string, score double")


ROWS = [(i, t) for i, t in enumerate(["", None, "One two THREE two", "é É ñandú 12ab x-y", "!!! ,,", "word " * 30] + [f"doc {j} " + " ".join(f"w{(j * k) % 17}" for k in range(15 + j % 30)) for j in range(120)])]
ROWS += [(None, "word " * 40), (3, "repeated id " * 20), (3, "repeated id " * 20), (50, ROWS[50][1]), (7000, "long Text7 " * 30_000)]
TARGET = ["w1 w2 w3 one two", None, "word", "é"]


def test_against_brute_force(spark, monkeypatch):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id int, text string")
    for args in ({}, {"percent": 50, "min_words": 1, "buckets": 13, "max_words": 3, "seed": 5}, {"percent": 100}, {"percent": 0}):
        assert sorted(map(tuple, resampled(docs_of(spark, ROWS), target, **args).collect()), key=repr) == brute(ROWS, TARGET, **args)
    monkeypatch.setattr(importance_resampling, "STREAM", 50)
    assert sorted(map(tuple, resampled(docs_of(spark, ROWS), target).collect()), key=repr) == brute(ROWS, TARGET)


def test_runs_that_cross_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    bucket = importance_resampling._Buckets(1 << 16)
    whole = {k: importance_resampling.text_buckets(text, bucket, k) for k in (1, 2, 4)}
    for piece in (1, 7, 30):
        monkeypatch.setattr(ascii_words, "PIECE", piece)
        for k, (n, found) in whole.items():
            got = importance_resampling.text_buckets(text, bucket, k)
            assert got[0] == n == 40 and sorted(got[1].tolist()) == sorted(found.tolist()) and len(found) == sum(40 - j for j in range(k))


def test_empty_tables(spark):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id int, text string")
    assert resampled(docs_of(spark, []), target).count() == 0
    assert sorted(map(tuple, resampled(docs_of(spark, ROWS), target.limit(0)).collect()), key=repr) == brute(ROWS, [])
    with pytest.raises(ValueError):
        resampled(docs_of(spark, ROWS), target, buckets=1 << 17)


def test_query_on_the_given_tables(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, d, "benchmark").collect()]
    assert sorted(map(tuple, op12_importance_resampling(spark, d).collect()), key=repr) == brute(docs, target)
