"""Byte-pair encoding by a deterministic automaton made from the merges, and decoding by its arc labels.

The automaton reads tokens and accepts a sequence of tokens exactly if byte-pair encoding its text gives that sequence. It
starts as one state with an arc for every symbol, all leading back to it. Each merge ``u v -> w``, in order, is one gadget:

* every state with an arc ``u``, behind which ``v`` may follow, gets an arc ``w`` to where that ``v`` leads;
* the state that ``u`` leads to loses its arc ``v``. If other tokens lead to that state, ``u`` gets a copy of its own first.

All arcs of one token lead to one state, so there are never more states than tokens and the start. A state is stored as what was cut from the state
it was copied from (which states form a tree), each cut with its merge's number: an arc ``w`` is there if neither it nor the
tokens it grew from on the left were cut before it grew. An arc looked up once is remembered in a table (state, token) -> bool.

A word is encoded from left to right: from the state reached, the longest token of a trie that has an arc is followed, a shorter one where
that leads to a dead end. Every prefix has one encoding, so a position left once is never entered again, and the path that reaches the
end of the word is the only one. Words are those of the file's normaliser and pre-tokeniser. Where these drop white space and look no further than
between two white spaces, a table of frequent white-space-delimited chunks saves repeating the work; the result is the same.

Decoding emits the label of each arc: with no decoder in the file labels are joined by one space, a byte-level decoder joins their bytes
(those that form no character become U+FFFD).

Strings of the file's special tokens in a text become their ids. Files whose encoding is not defined by merges alone (dropout, unknown
tokens, byte fallback, prefixes of continued words, merges out of order, unnormalised matching rules of special tokens) are refused.

Edge cases: NULL and empty texts have no ids and decode to the empty text; NULL lists decode like empty ones; texts and words of any
length are encoded whole; ids outside the vocabulary are refused; an empty table gives an empty result; other columns are kept, one named
like an added column is replaced.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import small_batches
from tidemark.llm.copies import without_names
from tidemark.llm.known import Known

VOCABULARY = "word_bpe_49k.json"
ARCS_KEPT = 1 << 21
WORDS_KEPT = 1 << 18  # chunks, and words, a worker remembers: up to twice as many of each, since a word encoded again costs far more
SLICE = 1 << 20  # characters encoded between two record batches
NEVER = 1 << 40
#: Unicode's White_Space characters; Python's ``split`` takes four control characters more.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_WHITE = re.compile("[\x1c-\x1f]")
FAR = re.compile("[^\0-\u024f]")
#: Normalisers that act within a run of characters that are not white space.
LOCAL_NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable Latin-1, else one from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


BYTE_CHARACTERS = byte_characters()


class Automaton:
    """States and arcs over token ids."""

    def __init__(self, symbols: Iterable[int], merges: list[tuple[int, int, int]], size: int):
        """``symbols``: ids the alphabet starts with; ``merges``: (u, v, w) in order; ``size``: ids are below it."""
        self.size = size
        self.target = [-1] * size  # the state that all arcs of a token lead to
        self.left = [-1] * size  # the first part of a merged token
        self.grown = [NEVER] * size  # the number of the merge that made a token
        self.cuts: list[dict[int, int]] = [{}]  # per state: token -> number of the merge that cut its arc
        self.parent, self.born = [-1], [0]  # per state: the state it was copied from, before which merge
        self.table: dict[int, bool] = {}
        for s in symbols:
            self.target[s], self.grown[s] = 0, -1
        shared = {0: sum(t == 0 for t in self.target) + 1}  # tokens that lead to a state, and the start
        for number, (u, v, w) in enumerate(merges):
            if self.grown[u] >= number or self.grown[v] >= number or self.grown[w] != NEVER:
                raise ValueError("merges must use earlier tokens and make new ones")
            self._gadget(number, u, v, w, shared)

    def _gadget(self, number: int, u: int, v: int, w: int, shared: dict[int, int]) -> None:
        state = self.target[u]
        alive = state >= 0 and self.target[v] >= 0 and self._arc(state, v)
        self.left[w], self.grown[w] = u, number
        if not alive:  # a pair that an earlier merge always takes apart: w has no arc anywhere
            return
        self.target[w] = self.target[v]
        shared[self.target[w]] += 1
        if shared[state] > 1:
            shared[state] -= 1
            self.parent.append(state)
            self.born.append(number)
            self.cuts.append({})
            state = self.target[u] = len(self.cuts) - 1
            shared[state] = 1
        self.cuts[state][v] = number
        if u == v:  # u u u is w u, never u w
            self.cuts[state][w] = number

    def _cut(self, state: int, token: int, before: int) -> bool:
        """Whether ``token``'s arc was cut from ``state`` by a merge numbered below ``before``."""
        while state >= 0:
            if self.cuts[state].get(token, NEVER) < before:
                return True
            state, before = self.parent[state], min(before, self.born[state])
        return False

    def _arc(self, state: int, token: int) -> bool:
        before = NEVER
        while token >= 0:
            if self._cut(state, token, before):
                return False
            token, before = self.left[token], self.grown[token]
        return True

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow in ``state``."""
        key = state * self.size + token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= ARCS_KEPT:
                self.table.clear()
            found = self.table[key] = self.target[token] >= 0 and self._arc(state, token)
        return found


class Tokenizer:
    """A vocabulary file: words, the automaton, and labels."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer as Library  # normalises and splits into words; it encodes nothing here

        file = json.loads(data)
        model = file["model"]
        odd = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix") if model.get(k)}
        if model["type"] != "BPE" or odd or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only byte-pair encodings that their merges define")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("only special tokens that are matched as they stand")
        kind = (file.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind}")
        self.bytes_joined = kind == "ByteLevel"
        library = Library.from_str(data.decode())
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.labels: list[str | None] = [None] * self.size
        for text, i in [*self.ids.items(), *self.special.items()]:
            self.labels[i] = text
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        made = {w for _, _, w in merges}
        self.symbols = {t: i for t, i in self.ids.items() if i not in made and len(t.removesuffix(self.suffix) if self.suffix else t) == 1}
        self.automaton = Automaton(self.symbols.values(), merges, self.size)
        self.found_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.chunks = Known(self._chunk, WORDS_KEPT) if self._white_space_apart(file) else None
        self.words = Known(self._word)
        self.near_words = self._near_words(file) if self.chunks is not None else None

    def _near_words(self, file: dict):
        """How to split a text of characters below U+0250, whose classes never change, without the library; None if it must not be done.

        There normal form C changes nothing, and lower case does not depend on the neighbours.
        """
        kinds = set(re.findall(r'"type": "(\w+)"', json.dumps(file.get("normalizer"))))
        if not kinds <= {"Sequence", "NFC", "Lowercase", "Replace"}:
            return None
        lower = "Lowercase" in kinds
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for group, letter in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", None)):
            near = sorted({c for x in range(0x250) for c in chr(x) + chr(x).lower()})
            inside = [c for c in near if (WHITE.match(c) if letter is None else unicodedata.category(c)[0] == letter)]
            pattern = pattern.replace(group, "".join(map(re.escape, inside)))
        split = re.compile(pattern).findall
        words = Known(lambda w: self._word("".join(map(BYTE_CHARACTERS.__getitem__, w.encode()))), WORDS_KEPT)
        return lambda text: [words[w] for w in split(text.lower() if lower else text)]

    @staticmethod
    def _white_space_apart(file: dict) -> bool:
        """Whether normaliser and pre-tokeniser treat what lies between white spaces on its own and drop white space."""

        def parts(x: dict | None, inner: str) -> list[dict]:
            return [] if x is None else [p for y in x[inner] for p in parts(y, inner)] if x["type"] == "Sequence" else [x]

        for n in parts(file.get("normalizer"), "normalizers"):
            blank = n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
            if n["type"] not in LOCAL_NORMALIZERS and not blank:
                return False
        steps = parts(file.get("pre_tokenizer"), "pretokenizers")
        split = bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        # A pattern of letters, digits and the rest that is not white space, without looking around.
        told = split and set(re.sub(r"\\p\{[LN]\}|\\s|'[a-z]{1,2}", "", steps[0]["pattern"].get("Regex", "?"))) <= set("|[]+^")
        matched = told and all("\\s" in s and s.startswith("[^") for s in re.findall(r"\[[^]]*\\s[^]]*\]", steps[0]["pattern"]["Regex"]))
        plain = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        return bool(matched and plain)

    @cached_property
    def trie(self) -> dict:
        """Symbols lead from a node to (next node, token that ends there or -1)."""
        root: dict[str, list] = {}
        suffix = self.suffix
        for text, token in self.ids.items():
            if self.automaton.target[token] < 0:
                continue
            ended = bool(suffix) and text.endswith(suffix) and text != suffix
            symbols = list(text.removesuffix(suffix)) if ended else list(text)
            if ended:
                symbols[-1] += suffix
            node, entry = root, None
            for s in symbols:
                entry = node.setdefault(s, [{}, -1])
                node = entry[0]
            entry[1] = token
        return root

    def _word(self, word: str) -> bytes:
        """Ids of one word, already in the characters of the vocabulary; symbols outside it are left out, as the library does."""
        suffix, root, automaton = self.suffix, self.trie, self.automaton
        symbols = [*word[:-1], word[-1] + suffix]
        if any(s not in self.symbols for s in symbols):
            symbols = [s for s in symbols if s in self.symbols]
        n, arc, target, table, size = len(symbols), automaton.arc, automaton.target, automaton.table, automaton.size
        out: list[int] = []  # the tokens up to ``at``
        ends = [0]  # where they begin and end
        seen = bytearray(n + 1)
        ways: list[list[int]] = []  # per token of ``out`` and for ``at``: other tokens from there, the longest last, with their ends
        at, row, fresh = 0, 0, True
        while at < n:
            if fresh:
                node, found = root, []
                for end in range(at, n):
                    entry = node.get(symbols[end])
                    if entry is None:
                        break
                    node, token = entry
                    if token >= 0:
                        found += (end + 1, token)
                ways.append(found)
            found = ways[-1]
            while found:
                token, end = found.pop(), found.pop()
                if seen[end]:
                    continue
                known = table.get(row + token)
                if known or known is None and arc(row // size, token):
                    out.append(token)
                    ends.append(end)
                    seen[end] = 1
                    at, row, fresh = end, target[token] * size, True
                    break
            else:  # a dead end: every prefix has one encoding, so no other path leads on from here either
                ways.pop()
                out.pop()
                ends.pop()
                at, row, fresh = ends[-1], (target[out[-1]] if out else 0) * size, False
        return struct.pack(f"<{len(out)}I", *out)

    def _chunk(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if self.near_words is not None and (text.isascii() or FAR.search(text) is None):
            return b"".join(self.near_words(text))
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        words = self.splitter.pre_tokenize_str(text) if self.splitter is not None else [(text, None)]
        return b"".join([self.words[w] for w, _ in words if w])

    def _plain(self, text: str) -> bytes:
        if self.chunks is None:
            return self._chunk(text) if text else b""
        pieces = text.split() if NOT_WHITE.search(text) is None else [p for p in WHITE.split(text) if p]
        return b"".join(map(self.chunks.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self.found_special is None or self.found_special.search(text) is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.found_special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    @cached_property
    def arc_labels(self) -> pa.Array:
        """The label of each id as bytes; ids nothing has are NULL."""
        if self.bytes_joined:
            byte_of = {c: b for b, c in enumerate(BYTE_CHARACTERS)}
            plain = [t is not None and all(c in byte_of for c in t) for t in self.labels]
            return pa.array([t if t is None else bytes(map(byte_of.__getitem__, t)) if p else t.encode() for t, p in zip(self.labels, plain)], pa.binary())
        return pa.array([t if t is None else t.encode() + b" " for t in self.labels], pa.binary())

    def decode_lists(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """Texts of consecutive lists of ids: list k is ``ids[ends[k]:ends[k + 1]]``."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("ids outside the vocabulary")
        labels = self.arc_labels.take(pa.array(ids))
        if labels.null_count:
            raise ValueError("ids outside the vocabulary")
        offsets = np.frombuffer(labels.buffers()[1], np.int32)[labels.offset : labels.offset + len(labels) + 1]
        data = memoryview(labels.buffers()[2] or b"")
        for a, b in zip(ends[:-1], ends[1:]):
            if a == b:
                yield ""
            else:
                last = offsets[b] - (0 if self.bytes_joined else 1)
                yield str(data[offsets[a] : last], "utf-8", "replace")


_LOADED: dict[bytes, Tokenizer] = {}


def loaded(file: bytes) -> Tokenizer:
    """The tokenizer of a file, made once in a worker."""
    key = hashlib.sha256(file).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(file)
    return _LOADED[key]


def file_bytes(path: str) -> bytes:
    """The vocabulary file, read by the driver and sent along with the tasks (two megabytes), which need no such file."""
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, file: bytes, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    docs = without_names(docs, [into])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(file).encode
        for b in batches:
            parts, ends, size, first = [], [0], 0, 0
            for i, value in enumerate(b.column(text)):
                t = value.as_py()
                parts.append(encode(t))
                ends.append(ends[-1] + len(parts[-1]) // 4)
                size += len(t or "")
                if size >= SLICE or i + 1 == b.num_rows:
                    values = pa.array(np.frombuffer(b"".join(parts), np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(lists)).columns, lists], [*b.schema.names, into])
                    parts, ends, size, first = [], [0], 0, i + 1

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column, and where each row's begin and end among them."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def decoded(docs: DataFrame, file: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of each list of ids."""
    docs = without_names(docs, [into])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(file)
        for b in batches:
            texts = pa.array(tokenizer.decode_lists(*_flat(b.column(ids))), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())]))


def id_digests(docs: DataFrame, ids: str = "ids", into: str = "ids_sha256") -> DataFrame:
    """``docs`` with the sha256 of each list of ids as little-endian unsigned 32-bit numbers."""
    docs = without_names(docs, [into])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, ends = _flat(b.column(ids))
            raw = memoryview(numbers.astype("<u4").tobytes())
            hashes = [hashlib.sha256(raw[4 * a : 4 * e]).hexdigest() for a, e in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.string())], [*b.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())]))


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    return importlib.import_module("public_tokenizers").path(name)


def op12_bpe_automaton(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's ids and their decoded text, as digests."""
    file = file_bytes(path or vocabulary_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = encoded(docs, file).drop("text")
    read = decoded(id_digests(ids), file)
    size = F.size("ids").cast("long").alias("n_tokens")
    return read.select("doc_id", size, "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op12_bpe_automaton": op12_bpe_automaton}
