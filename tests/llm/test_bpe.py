import hashlib
import json
import random

import numpy as np
import pytest

from tests.conftest import SF
from tidemark.llm import bpe_automaton as bpe

tokenizers = pytest.importorskip("tokenizers")

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = bpe.vocabulary_path(request.param)
    return bpe.Tokenizer(bpe.file_bytes(path)), tokenizers.Tokenizer.from_file(path)


def ids(t, text):
    return np.frombuffer(t.encode(text), "<u4").tolist()


def texts():
    rnd = random.Random(5)
    near = "abcdeinthearost 's't  \t\n.,!?'-019ÀéΣσİ́ß中文 \x1c\x1f\x85​あ😀👍🏽՘࢏"
    out = ["".join(rnd.choice(near) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    out += ["".join(chr(rnd.choice([rnd.randrange(0x20, 0x3000), rnd.randrange(0x3000, 0xD7FF), rnd.randrange(0x10000, 0x1FFFF)])) for _ in range(40)) for _ in range(500)]
    out += [s * k for s in ("a", "ha", "lol", "!", "0", "--") for k in range(1, 70)]
    out += ["".join(rnd.choice("aeinth") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    return out + ["", " ", "\n\n", "<|endoftext|>", "a<|endoftext|><|startoftext|> b <|endoftext|", "x" * 30000, "don't DON'T 'tis ''s"]


def test_like_the_library(pair):
    t, library = pair
    given = texts()
    want = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    for text, mine in zip(given, want):
        assert ids(t, text) == mine, text[:80]
    ends = np.concatenate([[0], np.cumsum([len(w) for w in want])])
    flat = np.array([i for w in want for i in w], np.int32)
    assert list(t.decode_lists(flat, ends)) == [library.decode(w, skip_special_tokens=False) for w in want]


def test_every_code_point(pair):
    """Characters whose classes differ between Unicode versions, too."""
    t, library = pair
    for start in range(0, 0x30000, 64):
        if not 0xD800 <= start < 0xE000:
            text = " ".join(f"a{chr(c)}1" for c in range(start, start + 64))
            assert ids(t, text) == library.encode(text, add_special_tokens=False).ids, hex(start)


def merged(word, merges):
    """Byte-pair encoding by definition."""
    parts = list(word)
    while True:
        found = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = ["".join(parts[i : i + 2])]


def test_gadgets_accept_encodings_only():
    """For random merges, exactly the encodings of all words up to 6 letters have a path."""
    rnd = random.Random(2)
    for _ in range(60):
        tokens, merges = ["a", "b"], []
        while len(merges) < 7:
            u, v = rnd.choice(tokens), rnd.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        number = {t: i for i, t in enumerate(tokens)}
        automaton = bpe.Automaton([0, 1], [(number[u], number[v], number[u + v]) for u, v in merges], len(tokens))
        assert len(automaton.cuts) <= len(tokens) + 1

        def paths(word, state=0):
            if not word:
                yield []
            for t in tokens:
                if word.startswith(t) and automaton.arc(state, number[t]):
                    for rest in paths(word[len(t) :], automaton.target[number[t]]):
                        yield [t, *rest]

        for n in range(1, 7):
            for k in range(2**n):
                word = "".join("ab"[k >> i & 1] for i in range(n))
                assert list(paths(word)) == [merged(word, merges)], (merges, word)


def test_refused_files():
    file = json.loads(bpe.file_bytes(bpe.vocabulary_path()))
    for change in ({"dropout": 0.1}, {"unk_token": "!"}, {"byte_fallback": True}, {"merges": file["model"]["merges"][::-1]}):
        with pytest.raises(ValueError):
            bpe.Tokenizer(json.dumps(file | {"model": file["model"] | change}).encode())


def test_columns_and_edges(spark):
    path = bpe.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  WORLD", "x"), (3, "Hello  WORLD", "x"), (None, "sp<|endoftext|>am " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = bpe.decoded(bpe.id_digests(bpe.encoded(docs, bpe.file_bytes(path))), bpe.file_bytes(path)).collect()
    assert len(got) == 5
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == library.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encoded(docs.limit(0), bpe.file_bytes(path)).count() == 0
    none = spark.createDataFrame([(None,), ([],), ([5, 5],)], "ids array<int>")
    assert [r.decoded for r in bpe.decoded(none, bpe.file_bytes(path)).collect()] == ["", "", library.decode([5, 5])]
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decoded(spark.createDataFrame([([99999],)], "ids array<int>"), bpe.file_bytes(path)).collect()


def test_query(spark):
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op12_bpe_automaton(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        raw, text = np.array(want, "<u4").tobytes(), library.decode(want, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(want), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_chunks_seen_before_are_not_encoded_again():
    """As many distinct chunks as a worker meets in tens of megabytes of text."""
    t = bpe.Tokenizer(bpe.file_bytes(bpe.vocabulary_path()))
    encode, encoded = t.chunks.encode, []
    t.chunks.encode = lambda text: encoded.append(text) or encode(text)
    text = " ".join(map(str, range(150_000)))
    first = t.encode(text)
    assert t.encode(text) == first and len(encoded) == 150_000
