import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import sentencepiece_nbest as sn

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def five():
    return sn.lattice(PATH, 5)


def brute(own, text):
    """Scores of all paths over the lattice of a normalised text, best first."""
    out = []

    def go(at, score):
        if at == len(text):
            out.append(score)
            return
        single = False
        for end in range(at + 1, len(text) + 1):
            hit = own.pieces.get(text[at:end])
            if hit:
                go(end, score + hit[0])
                single |= end == at + 1
        if not single:
            go(at + 1, score + sn.BYTE_SCORE * len(text[at].encode()))

    go(0, 0)
    return sorted(out, reverse=True)


@pytest.mark.parametrize("text", ["the end!!", "a  b", "\n\n", "éaux et", "thhaen", "日本 x", "𐍈", "of the", " "])
def test_n_best_against_all_paths(five, text):
    want = brute(five, sn.SPACE + text.replace(" ", sn.SPACE))[:5]
    assert [s for s, _ in five.nbest(text)] == want == five.encode(text)[1]
    paths = [tuple(i) for _, i in five.nbest(text)]
    assert len(set(paths)) == len(paths)
    assert {five.decode(np.asarray(p, "<u4").tobytes()) for p in paths} == {text}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abtheéß !.*|\n\t0日𐍈")), max_size=60))
def test_round_trip_and_merged_scores(text):
    own = sn.lattice(PATH, 3)
    ids, scores = own.encode(text)
    assert own.decode(ids) == text
    assert scores == [s for s, _ in own.nbest(text)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert library.decode(np.frombuffer(ids, "<u4").tolist()) == text


def test_operator_and_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x" * 60_000), (5, "word " * 40_000)]
    docs = spark.createDataFrame([(a, b, "p") for a, b in rows], "doc_id long, text string, pieces string")
    got = sn.encoded(docs, PATH, with_ids=True).collect()
    own = sn.lattice(PATH)
    assert sorted(((r.doc_id or 0, r.n_pieces, r.best_score) for r in got)) == sorted((a or 0, len(own.encode(b)[0]) // 4, own.encode(b)[1][0]) for a, b in rows)
    assert all(r.round_trip and len(r.pieces) == r.n_pieces for r in got)
    assert sn.encoded(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["a   b", "   x", "x   ", "a\n    b"])
def test_runs_of_spaces_against_all_paths_of_the_model_file(five, text):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)

    class Whole:
        pieces = {model.id_to_piece(i): (max(round(model.get_score(i)), -model.get_piece_size()), i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}

    assert sn.SPACE * 16 in Whole.pieces
    assert five.encode(text)[1] == brute(Whole, sn.SPACE + text.replace(" ", sn.SPACE))[:5]


def test_spaces_at_the_end_stay_with_their_text(five):
    texts = ["a  ", "b" + " " * 16 + "c", "", "  d"]
    got = five.encode_group(texts)
    assert got == [five.encode(t) for t in texts] and [five.decode(ids) for ids, _ in got] == texts
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert model.piece_to_id(sn.SPACE * 16) in np.frombuffer(got[1][0], "<u4")


def test_a_batch_is_encoded_in_small_groups(monkeypatch):
    import pyarrow as pa

    own, seen = sn.lattice(PATH, 3), []
    before = own.encode_arrays
    monkeypatch.setattr(own, "encode_arrays", lambda texts: (seen.append(sum(map(len, texts))), before(texts))[1])
    texts = ["one two three " * 5000, None, ""] * 10
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = pa.Table.from_batches(sn._encode(PATH, 3, True)(iter([batch]))).to_pydict()
    assert max(seen) <= 250_000 + len(texts[0]) and out["doc_id"] == list(range(30))
    assert [np.array(x, "<u4").tobytes() for x in out["pieces"]] == [before([x or ""])[0].astype("<u4").tobytes() for x in texts]
