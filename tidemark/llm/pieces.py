"""SentencePiece encoding and decoding by a streaming Viterbi over a bounded window.

A model file gives pieces, scores and a kind. Text is walked once; for each position the trellis keeps the best way to
cover the text up to it, with a back-pointer to the position before its last piece. Only positions within the longest
piece of the front can still be reached from, so the trellis is a window of that length. Whenever the back-pointers of all
positions in the window lead through one boundary, the ids up to it are final: they are committed and forgotten, so memory
does not grow with the text.

What "best" means is the model's kind:

* unigram: the largest sum of scores (unknown characters cost the smallest score less ten), as the library's own search,
  up to ties: the library adds in single precision from the start of the text, here sums start at each word.
* bpe: the piece that ends the byte-pair encoding of the text so far. A sequence of pieces is the encoding of its text
  exactly if every two neighbours are the encoding of theirs, so at each position one piece fits the path before it,
  and the same trellis finds it; neighbours are checked by running the merges on the two pieces, and remembered.

Characters outside the vocabulary become byte pieces. In words that no piece can span (every piece has white space only
in front), paths converge before each white-space run, so words are encoded one by one and a bounded table of frequent
words saves repeating the work; the result is the same.

White space is the mark U+2581, one is put in front of a text that is not empty, and nothing else is normalised; models that
ask for more are refused. Decoding turns ids back into text: byte pieces join into characters (bytes that form none become
U+FFFD), the leading mark goes. Encoding and decoding a text without U+2581 gives it back.

Edge cases: NULL and empty texts have no ids and decode to the empty text; U+2581 in a text is white space, as in the library;
texts of any length are encoded whole; control ids decode to nothing and unknown ones to " \\u2047 "; other columns are kept, one named like the added column is replaced.
"""

from __future__ import annotations

import heapq
import struct
from array import array
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

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
WORDS_KEPT, PAIRS_KEPT = 1 << 19, 1 << 19
NOTHING = ({}, -1)
SLICE = 1 << 20  # characters encoded between two record batches


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        elif kind == 1:
            value, at = struct.unpack("<d", data[at : at + 8])[0], at + 8
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


class Pieces:
    """The vocabulary, the search and the way back."""

    def __init__(self, data: bytes):
        self.texts, self.scores, self.types = [], [], []
        self.kind, self.fallback, prefix, extra = UNIGRAM, False, True, True
        for field, value in fields(data):
            if field == 1:
                piece = dict(fields(value))
                self.texts.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(fields(value))
                self.kind, self.fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif field == 3:
                norm = dict(fields(value))
                prefix, extra, name = bool(norm.get(3, 1)), bool(norm.get(4, 1)), norm.get(1, b"")
                if name != b"identity" or norm.get(2, b"") or not norm.get(5, 1):
                    raise ValueError("only models without normalisation rules")
        if not prefix or extra or self.kind not in (UNIGRAM, BPE) or USER in self.types:
            raise ValueError("only unigram and bpe models with a dummy prefix that keep white space")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.types)) if k == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.types)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        # No piece has white space behind another character: paths converge before every white-space run.
        self.words_apart = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        special = {UNKNOWN: " \u2047 ", CONTROL: "", BYTE: None}
        self.plain = [special.get(k, t) for t, k in zip(self.texts, self.types)]
        self.sizes = [len(t) for t in self.texts] + [1]  # the last entry, [-1], is a character without a piece
        self.fits: dict[int, bool] = {}
        self.known = Known(lambda w: self._packed(SPACE + w), WORDS_KEPT)  # words behind one space

    @cached_property
    def trie(self) -> dict[str, tuple[dict, int]]:
        """A character leads from a node to the next one and the id of the piece that ends there, or -1."""
        trie: dict[str, tuple[dict, int]] = {}
        for t in sorted(self.ids):  # beginnings of a piece come before it
            if self.kind == UNIGRAM or len(t) == 1 or self.merged(t) == [t]:  # else it is in no encoding
                node = trie
                for ch in t[:-1]:
                    node = node.setdefault(ch, ({}, -1))[0]
                node[t[-1]] = (node.get(t[-1], ({},))[0], self.ids[t])
        return trie

    # -- the search ---------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Byte-pair encoding by definition: again and again the best-scored neighbouring pair, leftmost first."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (joined := parts[i] + parts[j]) in self.ids:
                heapq.heappush(heap, (-self.scores[self.ids[joined]], i, joined))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def apart(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart when their joint text is byte-pair encoded."""
        key = left * len(self.texts) + right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            a, b = self.texts[left], self.texts[right]
            found = self.fits[key] = self.merged(a + b) == [a, b]
        return found

    def path(self, text: str) -> Iterator[int]:
        """The best pieces of ``text`` (-1 for a character that has none), committed as soon as all surviving paths agree.

        ``last`` holds, for each position of the window that a path ends in, the last piece of the best path to it, which is its
        back-pointer, and ``score`` the path's sum. From every such position the pieces that go on are followed in the trie.
        ``start`` is the boundary up to which pieces are out.
        """
        longest, trie, scores, bpe, fits, many = self.longest, self.trie, self.scores, self.kind == BPE, self.fits, len(self.texts)
        last: dict[int, int] = {0: -1}
        score: dict[int, float] = {0: 0.0}
        start = committed = 0
        n = len(text)
        for begin in range(n):
            before = last.get(begin)
            if before is None:
                continue
            node, i = trie.get(text[begin], NOTHING)
            end = begin + 1
            if bpe:
                # One piece fits each position: the first one found.
                if end not in last and (i < 0 or before < 0 or fits.get(before * many + i) or self.apart(before, i)):
                    last[end] = i
                row = before * many
                for ch in text[end : begin + longest]:
                    entry = node.get(ch)
                    if entry is None:
                        break
                    node, i = entry
                    end += 1
                    if i >= 0 and end not in last:
                        fit = before < 0 or fits.get(row + i)
                        if fit or (fit is None and self.apart(before, i)):
                            last[end] = i
                if n in last:  # the one piece that fits the end: what lies between cannot change the path back from there
                    break
            else:
                so_far = score[begin]
                total = so_far + (scores[i] if i >= 0 else self.unknown_score)
                if end not in last or total > score[end]:
                    last[end], score[end] = i, total
                for ch in text[end : begin + longest]:
                    entry = node.get(ch)
                    if entry is None:
                        break
                    node, i = entry
                    end += 1
                    if i >= 0:
                        total = so_far + scores[i]
                        if end not in last or total > score[end]:
                            last[end], score[end] = i, total
            if begin - committed >= 4 * longest:
                committed = begin
                boundary = self._agreed(last, start, begin)
                if boundary > start:
                    yield from self._back(last, start, boundary)
                    start = boundary
                for old in [p for p in last if p < start]:
                    del last[old]
                    score.pop(old, None)
        yield from self._back(last, start, n)

    def _agreed(self, last: dict[int, int], start: int, front: int) -> int:
        """The boundary that the paths of all positions still open, those beyond ``front``, lead through."""
        ends = {p for p in last if p > front} or {front}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - self.sizes[last[far]])
        return max(min(ends), start)

    def _back(self, last: dict[int, int], start: int, end: int) -> list[int]:
        out = []
        while end > start:
            out.append(last[end])
            end -= self.sizes[out[-1]]
        return out[::-1]

    # -- texts --------------------------------------------------------------------------------------------------

    def word(self, text: str) -> list[int]:
        """Ids of a text that starts at a boundary of its own."""
        found = list(self.path(text))
        if not found or min(found) >= 0:
            return found
        out: list[int] = []
        at = 0
        for i in found:
            if i >= 0:
                out.append(i)
            elif self.fallback:
                out.extend(self.bytes[b] for b in text[at].encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += self.sizes[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def encoded(self, text: str | None) -> bytes:
        """The ids of a whole text as machine integers."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.words_apart:
            return self._packed(SPACE + text.replace(" ", SPACE))
        words = text.split(" ")
        if "" not in words:
            return b"".join(map(self.known.__getitem__, words))
        out: list[bytes] = []
        run = 1
        for w in words:
            if not w:
                run += 1
                continue
            # White space before a word may merge with it.
            out.append(self.known[w] if run == 1 else self._packed(SPACE * run + w))
            run = 1
        if run > 1:
            out.append(self._packed(SPACE * (run - 1)))
        return b"".join(out)

    def _packed(self, text: str) -> bytes:
        return array("i", self.word(text)).tobytes()

    def decode(self, ids) -> str:
        try:
            text = "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # byte pieces
            text = "".join(self._parts(ids))
        return text.removeprefix(SPACE).replace(SPACE, " ")

    def _parts(self, ids) -> Iterator[str]:
        held = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                yield held.decode("utf-8", "replace")
                held.clear()
            yield self.plain[i]
        if held:
            yield held.decode("utf-8", "replace")


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The vocabulary of a model, made once in a worker."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def model_bytes(path: str) -> bytes:
    """The model file, read by the driver and sent along with the tasks (half a megabyte), which need no such file."""
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text; one pass, no shuffle."""

    small_batches(docs.sparkSession)
    docs = without_names(docs, [into])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(model).encoded
        for b in batches:
            parts, ends, size, first = [], [0], 0, 0
            for i, value in enumerate(b.column(text)):
                t = value.as_py()
                parts.append(encode(t))
                ends.append(ends[-1] + len(parts[-1]) // 4)
                size += len(t or "")
                if size >= SLICE or i + 1 == b.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(lists)).columns, lists], [*b.schema.names, into])
                    parts, ends, size, first = [], [0], 0, i + 1

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decoded(docs: DataFrame, model: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of each list of ids."""

    docs = without_names(docs, [into])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = loaded(model).decode
        for b in batches:
            texts = pa.array([decode(i.tolist() if i is not None else []) for i in _lists(b.column(ids))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())]))


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    values, at = column.flatten().to_numpy(zero_copy_only=False), 0
    for valid, n in zip(column.is_valid().to_pylist(), column.value_lengths().fill_null(0).to_pylist()):
        yield values[at : at + n] if valid else None
        at += n


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether decoding them gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = model_bytes(MODEL)
    ids = encoded(docs.withColumn("given", F.md5(F.coalesce("text", F.lit("")).cast("binary"))), model).drop("text")
    same = F.md5(F.col("decoded").cast("binary")) == F.col("given")
    return decoded(ids, model).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
