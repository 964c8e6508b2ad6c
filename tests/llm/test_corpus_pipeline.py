"""Each stage of the pipeline against a brute-force version of its decision, on the stage's own input."""

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from graphloom.llm import mixing, quality_rules, sentencepiece_nbest
from graphloom.llm.shared import stored
from tests.llm.test_line_templates import brute as brute_lines
from tests.llm.test_mixing import brute as brute_mixing
from tests.llm.test_quality_rules import brute as brute_base
from tests.llm.test_near_copies import brute_groups

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage over the smallest tables."""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = stored(f(spark, docs, D), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def test_all_but_the_last_return_the_columns_of_documents(spark, stages):
    columns = spark.read.parquet(f"{D}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])


def test_quality_stage(spark, stages):
    before, after = stages[0]
    model = quality_rules.fit(before, spark.read.parquet(f"{D}/labels.parquet"))
    keep = set()
    for r in before.collect():
        if brute_base(r.text)[-1]:
            continue
        _, rows, chars = quality_rules.measure(r.text)
        e, t = np.asarray(rows) @ np.asarray(model[0]), np.asarray(model[1])
        best = np.zeros((len(e), 2))
        for i in range(len(e)):  # max-sum from the end
            j = len(e) - 1 - i
            after_ = best[j + 1] if i else np.zeros(2)
            best[j] = [(0 if y == 0 else e[j]) + (max(t[y, 0] + after_[0], t[y, 1] + after_[1]) if i else 0) for y in (0, 1)]
        label, labels = int(best[0][1] > best[0][0]), []
        for j in range(len(e)):
            labels.append(label)
            if j + 1 < len(e):
                label = int(t[label, 1] + best[j + 1][1] > t[label, 0] + best[j + 1][0])
        if np.dot(labels, chars) / sum(chars) >= quality_rules.MIN_CONTENT:
            keep.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == keep


def test_line_stage(stages):
    before, after = stages[1]
    docs = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
    assert {r.doc_id: r.text for r in after.collect()} == brute_lines(docs)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_duplicate_stage(stages):
    before, after = stages[2]
    docs = sorted((r.doc_id, r.text) for r in before.collect())
    label = brute_groups([t for _, t in docs])  # five words and a Jaccard of 0.8, as the stage's contract says
    assert sorted(r.doc_id for r in after.collect()) == sorted(docs[i][0] for i in set(label))


def test_mixing_stage(stages):
    before, after = stages[3]
    domain = lambda s: ["web", "books", "news", "forum"][int(s[3:]) % 4]
    rows = [(r.doc_id, domain(r.source), r.lang, r.source, len(r.text.encode().split())) for r in before.collect()]
    want = brute_mixing(rows, {(a, b): c for a, b, c in mixing.WEIGHTS}, corpus_pipeline.MIX_SHARE, corpus_pipeline.MIX_EPOCHS)
    assert {r.doc_id: 1 for r in after.collect()} == want


def test_encoding_stage(stages):
    before, after = stages[4]
    own = sentencepiece_nbest.lattice(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.asarray(r.pieces, "<u4").tobytes()
        assert r.round_trip and own.decode(ids) == texts[r.doc_id]
        assert r.nbest_scores == [s for s, _ in own.nbest(texts[r.doc_id])]


def test_nulls_repeats_and_empty_texts_pass_all_stages(spark, tmp_path):
    good = "The words of this text are all other ones, and each of them is told but once here. So it ends well enough."
    rows = [(None, None, None, None, None), (1, "", "en", "src1", 0), (2, good, "en", "src1", len(good)), (2, good, "en", "src1", len(good)), (None, "Here is another good page that shares no run of five words with the rest, so nothing should take it away.", None, None, 5), (None, "An unrelated text without an id stands for itself and is no copy of any other, so that it should stay.", "en", "src2", 9), (3, "x y " * 30_000, "de", "src3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1), (None, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for n, want in ((len(rows), 3), (0, 0)):
        now = docs.limit(n)
        for name, f in corpus_pipeline.STAGES[:3]:
            now = stored(f(spark, now, str(tmp_path)), f"test-{name}")
        assert now.count() == want and now.columns == docs.columns  # of the good ones, the repeated row stays once, and both without an id
        for name, f in corpus_pipeline.STAGES[3:]:
            now = stored(f(spark, now, str(tmp_path)), f"test-{name}")
        assert now.count() <= want


def test_stages_with_python_workers_get_small_arrow_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "bytes"])

    own = spark.newSession()
    docs = own.range(0, 30, 1, 1).selectExpr("id AS doc_id", "repeat('one two ', 100000) AS text")
    corpus_pipeline.encode(own, docs, D)
    found = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 30 and max(r.bytes for r in found) <= corpus_pipeline.ARROW_BYTES + 800_000 + 1000
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "3m")
    corpus_pipeline.encode(own, docs, D)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "3m"
