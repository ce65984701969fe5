import random

import pytest

from tidemark.llm import jaccard_join as J
from tidemark.llm import suffix_dedup as D
from tidemark.llm.shingles import PIECE, shingle_sets, word_hashes
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm import brute
from tests.llm.brute import ordered


def families():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 25)):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append((len(rows), " ".join(x[rng.randint(0, 2) :] if rng.random() < 0.3 else x)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "a b"), (1004, "A  b"), (1005, "a"), (None, "a b"), (None, "zz yy xx ww")]
    rows += [(3, "other text entirely here now"), (3, rows[3][1]), (3, rows[3][1]), (2000, "hot copy of a text " * 4)] + [(2001 + i, "hot copy of a text " * 4) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words, percent", [(3, 90), (2, 70)])
def test_components(spark, words, percent):
    rows = families()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component int").repartition(4)
    got = J.similarity_components(docs, words, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute.components(rows, words, percent))


def test_components_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(J.op6_grouped_prefix_join(spark, SF).collect()) == ordered(brute.components(rows, 3, 90))


def test_chains_and_variants(spark):
    """A base with many variants that do not link with each other, and a chain in which only neighbours link."""
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        x = list(base)
        x[i] = f"v{i}"
        rows.append((i, " ".join(x)))
    chain = [f"c{i}" for i in range(100)]
    rows += [(100 + k, " ".join(chain[k : k + 60])) for k in range(0, 40, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = J.similarity_components(docs, 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute.components(rows, 3, 90))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.similarity_components(none).count() == 0 and D.deduplicated(none).count() == 0


def test_shingles():
    texts = [None, "", " ", "a", "a b", "A B c", "a b c a b c a b c", "x" * (3 * PIECE) + " b c d", "w " * PIECE]
    sizes = shingle_sets(texts, 3)[1].tolist()
    assert sizes == [len(brute.shingles(t, 3)) for t in texts]
    h, n = shingle_sets(["A b c d", "a B c d x", "b c", "B c", "c b"], 3)
    sets = [set(h[sum(n[:i]) : sum(n[: i + 1])].tolist()) for i in range(5)]
    assert sets[0] < sets[1] and sets[2] == sets[3] != sets[4]


def passages():
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(20, 90))) for _ in range(40)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    rows += [(None, parts[0] * 3), (None, parts[0] * 3), (3, parts[1] * 4), (3, parts[1] * 4), (3, rows[3][1]), (200, None), (201, ""), (202, "a" * 400), (203, "a" * 130), (204, "ab" * 100)]
    rng.shuffle(rows)
    return rows


def test_repeated_bytes(spark):
    rows = passages()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string").repartition(5)
    out = D.deduplicated(docs, 50)
    assert out.columns == ["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans"]
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert ordered(got) == ordered(brute.deduplicated(rows, 50))


def test_repeated_bytes_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(D.op9_suffix_dedup(spark, SF).collect()) == ordered(brute.deduplicated(rows, 50))


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    block = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, block), (2, "x" * 100 + block * 3 + "tail"), (3, block[1000:1049] + "|" + block[500:550])]
    monkeypatch.setattr(D, "PIECE", 1 << 9)
    monkeypatch.setattr(D, "SORTED", 40)  # anchors place by place
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.deduplicated(docs, 50).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert ordered(got) == ordered(brute.deduplicated(rows, 50))


def test_a_lying_hash_is_found_out(monkeypatch):
    import numpy as np

    from tidemark.llm.rolling import Prefixes

    monkeypatch.setattr(Prefixes, "hashes", lambda self, start, end: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"abcdefgh" b"abcdefgx" b"abcdefgh", np.uint8)
    least = D.smallest_of_equal(Prefixes(data), np.array([0, 8, 16]), np.zeros(3, int), np.array([5, 1, 4]), 8)
    assert least.tolist() == [4, 1, 4]


def thue_morse(n: int, first: str = "a", second: str = "b") -> str:
    """Letters by the parity of their place's bits: words of which polynomial hashes modulo 2**64 cannot be told apart."""
    return "".join((first, second)[i.bit_count() & 1] for i in range(n))


def test_words_of_alike_form_do_not_link(spark):
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    assert len(set(word_hashes([x, y])[0].tolist())) == 2
    rows = [(1, x), (2, y), (3, f"{x} {y} {x}"), (4, f"{y} {x} {y}")]
    got = J.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize("seeds", [1, 3])
def test_rows_without_ids_keep_their_own_text(spark, monkeypatch, seeds):
    """Keys that collide for the first seeds: another is taken, and only copies lose anything."""
    real = D._key
    monkeypatch.setattr(D, "_key", lambda seed: F.lit(7).cast("long") if seed < seeds else real(seed))
    a, b = "x1 " * 22, "completely different text, of which no other document holds any part"
    rows = [(1, a), (None, a), (None, b), (None, None), (None, "")]
    got = D.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (0, 0), (len(a), 0), (len(a), len(a)), (len(b), 0)]
