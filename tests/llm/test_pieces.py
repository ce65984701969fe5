import math

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from tidemark.llm import pieces as P
from tests.conftest import SF

MODEL = P.model_bytes(P.MODEL)
OURS, THEIRS = P.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def unigram() -> bytes:
    """The same pieces as a unigram model with falling scores."""
    m = proto.ModelProto()
    m.ParseFromString(MODEL)
    m.trainer_spec.model_type = 1
    for i, piece in enumerate(m.pieces):
        if piece.type == P.NORMAL:
            piece.score = -math.log(i) * 1.7 - (i % 97) / 1000
    return m.SerializeToString()


def documents(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aetho n\n\t.é☃語0%$\\"), max_size=60))
def test_like_the_library(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode(text)
    assert OURS.decode(ids) == THEIRS.decode(ids) == text


def test_documents_like_the_library(spark):
    texts = documents(spark) + ["a" * 5000, " " * 100, "x" + " " * 37 + "y", "▁a▁▁b", "\x00😀", "日本語"]
    assert [OURS.encode(t) for t in texts] == THEIRS.encode(texts)


def test_unigram_has_the_best_sum(spark):
    data = unigram()
    ours, theirs = P.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert ours.kind == P.UNIGRAM
    for text in documents(spark)[:60]:
        mine, other = ours.encode(text), theirs.encode(text)
        total = [sum(ours.scores[i] for i in x) for x in (mine, other)]
        assert mine == other or abs(total[0] - total[1]) < 1e-3 * max(1, abs(total[0]))
        assert ours.decode(mine) == text


def test_window_commits_without_word_boundaries(spark):
    """The trellis alone, over whole texts, commits the same ids in a bounded window."""
    for data in (MODEL, unigram()):
        whole, words = P.Pieces(data), P.Pieces(data)
        whole.words_apart = False
        for text in [*documents(spark)[:8], "theandof" * 300]:
            assert whole.encode(text) == words.encode(text)
    path, widest = P.Pieces(MODEL), 0
    agreed = path._agreed

    def watched(last, start, front):
        nonlocal widest
        widest = max(widest, len(last))
        return agreed(last, start, front)

    path._agreed = watched
    list(path.path("▁" + "theandofinto" * 2000))
    assert widest <= 12 * path.longest


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "é☃ " * 3000)]
    docs = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, ids string")
    out = P.decoded(P.encoded(docs, MODEL), MODEL).collect()
    assert sorted((r.decoded for r in out), key=repr) == sorted((t or "" for _, t in rows), key=repr)
    assert {len(r.ids) for r in out if not r.text} == {0}
    assert P.encoded(docs.limit(0), MODEL).count() == 0
    assert P.op4_sentencepiece(spark, SF).where("NOT round_trip").count() == 0
