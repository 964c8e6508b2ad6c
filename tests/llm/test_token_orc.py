import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import token_orc
from graphloom.llm.shared import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abéßZ '’.,!*&<|>-_0½ⅷ２ \t\n\r 　x日́ ٣")), max_size=40))
def test_chunks_encode_as_whole_texts(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_chunks_encode_as_whole_texts, "t") else test_chunks_encode_as_whole_texts.t
    test_chunks_encode_as_whole_texts.t = t
    got = np.frombuffer(token_orc.encoder(PATH).encode([text])[0], "<u4").tolist()
    assert got == t.encode(text, add_special_tokens=False).ids


def test_round_trip_against_brute_force(spark, plain):
    rows = [(5, "One text. <|endoftext|> It's  here"), (2, None), (9, ""), (7, "long " * 30_000), (3, "same"), (4, "same"), (None, "no id")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, tokens string")
    path = scratch(spark, "test-orc")
    token_orc.write_token_orc(docs, path, tokenizer_path=PATH, end_id=0, shards=3, stripe_bytes=1 << 20, row_index_stride=1000)
    got = sorted(map(tuple, token_orc.token_digests(spark, path).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [plain.encode(x or "", add_special_tokens=False).ids + [0] for _, x in ordered]
    starts = [0, *accumulate(map(len, ids))]
    assert got == [(r[0], s, len(i), zlib.crc32(np.asarray(i, "<u4").tobytes())) for r, s, i in zip(ordered, starts, ids)]
    back = {r.doc_id: r.tokens for r in token_orc.read_token_orc(spark, path).filter("doc_id = 7").collect()}
    assert plain.decode(back[7][:-1]) == "long " * 30_000
    plan = token_orc.read_token_orc(spark, path).filter("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan


def test_special_tokens_as_the_library_encodes_them(plain):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z", "<|endoftext>"]
    got = token_orc.encoder(PATH).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert np.frombuffer(got[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_empty_table(spark):
    path = scratch(spark, "test-orc")
    token_orc.write_token_orc(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_path=PATH, end_id=0, shards=2)
    assert token_orc.token_digests(spark, path).count() == 0


def test_a_worker_keeps_a_bounded_number_of_entries(plain, monkeypatch):
    monkeypatch.setattr(token_orc, "CACHE", 10)
    own = token_orc.ChunkEncoder(PATH)
    for texts in (["a b c"], [" ".join(f"word{i}" for i in range(50)), "a b"], ["a b c word7"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(own.known) <= 10
