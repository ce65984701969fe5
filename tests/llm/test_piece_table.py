import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import piece_table as pt


def plain(doc_id, text, seed, rate, spm):
    """(n, form, characters of prefix and middle, output) with plain strings."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "ä\n日本\n😀\n\nend", "x <P> y", "<S>", "a<M>\nb", "<P\n>", "line\n" * 50_000, "long" * 300_000, "\r\n\r\n", "tail\n "]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_like_the_plain_version(spark, rate, spm):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS * 3)] + [(None, "a\nb\nc", "x", 1), (5, "twice\nhere\n", "x", 1), (5, "twice\nhere\n", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Output string, n int").repartition(3)
    made = pt.fill_in_middle(docs, 7, rate, spm)
    got = [(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(((d, t, *plain(d, t, 7, rate, spm)) for d, t, *_ in rows), key=repr)
    for r in pt.digested(made).collect():
        whole = plain(r.doc_id, r.text, 7, rate, spm)[-1]
        assert r.output_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert pt.digested(pt.fill_in_middle(docs.limit(0), 7)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n<>PSMé😀", max_size=40), st.integers(0, 1 << 40))
def test_round_trip(text, doc_id):
    table, form, *_ = pt.transformed(text.encode(), pt.numbers(doc_id, 7), 100, 50)
    assert pt.read_back(table.render(), form).render().decode() == text
    assert table.digest() == hashlib.sha256(table.render()).hexdigest()
    if form != "plain":
        assert table.restored(pt.ARRANGEMENTS[form]).render().decode() == text


def test_descriptors_cover_the_text_once(spark):
    """Descriptors, not copies: seven at most, those over the text a permutation of its bytes."""
    docs = spark.createDataFrame([(i, "one\ntwo\nthree\n" * i) for i in range(1, 40)], "doc_id long, text string")
    for r in pt.fill_in_middle(docs, 3).collect():
        over = sorted((p.start, p.size) for p in r.pieces if p.buffer == pt.TEXT)
        assert len(r.pieces) == 6 and sum(s for _, s in over) == len(r.text.encode())
        assert all(a + s == b for (a, s), (b, _) in zip(over, over[1:]))
        joined = b"".join([r.text.encode(), pt.SENTINELS][p.buffer][p.start : p.start + p.size] for p in r.pieces)
        assert joined.decode() == r.output


def test_cuts_and_refusals():
    table = pt.PieceTable(b"abcdef")
    assert [p.size for p in table.cut(2).cut(2).pieces] == [2, 0, 4]
    assert table.cut(6).cut(0).render() == b"abcdef"
    with pytest.raises(ValueError):
        table.cut(7)
    with pytest.raises(ValueError):
        pt.read_back(b"<S>a<P>b<M>c", "psm")
