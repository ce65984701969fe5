"""Fill-in-middle transformation with a piece table.

A document is never copied while it is rearranged. Two buffers never change: the text's UTF-8 bytes and the sentinels. A document
is a list of descriptors (buffer, start, size), at first one over the whole text. Cutting splits a descriptor at a byte
offset, an arrangement permutes descriptors and puts sentinels between them, and the inverse permutation of what lies between the
sentinels of an output restores the text. Digests and code point counts stream over the descriptors' bytes; output text is joined
only where a column asks for it.

Units are the lines of a text (with their line breaks; a last line may lack one). Four 32-bit numbers, the first digits of the sha256
of ``seed:id``, choose the two cuts, whether the document is rearranged at all, and how:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text itself; always so for an empty text and one that holds a sentinel, so that every output can be read back.

One pass over the rows, no shuffle; a task holds one record batch of whole texts.

Edge cases: a NULL text is the empty text, which is plain; a NULL id hashes as ``seed:`` alone; texts of any length are
cut whole; repeated rows and equal ids are transformed alike; an empty table gives an empty result; other columns are kept, one
named like an added column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import small_batches
from tidemark.llm.copies import without_names

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Which part (0 prefix, 1 middle, 2 suffix) stands where; each part follows its own sentinel.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARK_OF = (0, 2, 1)  # the sentinel in MARKS of each part
TEXT, ADDED = 0, 1  # the buffers
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "pieces", "output")


@dataclass(frozen=True)
class Piece:
    buffer: int
    start: int
    size: int


class PieceTable:
    """Descriptors over a text buffer and the sentinels' buffer; every edit gives a new list over the same buffers."""

    def __init__(self, text: memoryview | bytes, pieces: list[Piece] | None = None):
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [Piece(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, at: int) -> PieceTable:
        """The descriptor that spans offset ``at`` becomes two; at either end of the table one of them is empty."""
        out, begin, done = [], 0, False
        for p in self.pieces:
            if not done and begin <= at <= begin + p.size:
                out += [Piece(p.buffer, p.start, at - begin), Piece(p.buffer, p.start + at - begin, begin + p.size - at)]
                done = True
            else:
                out.append(p)
            begin += p.size
        if not done:
            raise ValueError("a cut beyond the end")
        return PieceTable(self.buffers[TEXT], out)

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        """The parts in a new order, each behind its sentinel."""
        out = []
        for part in order:
            mark = MARK_OF[part]
            out += [Piece(ADDED, mark * len(PREFIX), len(PREFIX)), self.pieces[part]]
        return PieceTable(self.buffers[TEXT], out)

    def restored(self, order: tuple[int, ...]) -> PieceTable:
        """The parts between the sentinels in their first order: the inverse permutation."""
        parts = self.pieces[1::2]
        return PieceTable(self.buffers[TEXT], [parts[order.index(k)] for k in range(len(order))])

    def spans(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield self.buffers[p.buffer][p.start : p.start + p.size]

    def digest(self) -> str:
        """sha256 of the whole, streamed over the descriptors."""
        h = hashlib.sha256()
        for span in self.spans():
            h.update(span)
        return h.hexdigest()

    def render(self) -> bytes:
        return b"".join(self.spans())


def code_points(utf8: memoryview | bytes) -> int:
    """Bytes that do not go on with a character."""
    return int(np.count_nonzero((np.frombuffer(utf8, np.uint8) & 0xC0) != 0x80))


def line_ends(utf8: memoryview | bytes) -> np.ndarray:
    """The byte offsets behind each line; the last line may lack its line break."""
    ends = np.flatnonzero(np.frombuffer(utf8, np.uint8) == 10) + 1
    return ends if len(utf8) == 0 or (len(ends) and ends[-1] == len(utf8)) else np.append(ends, len(utf8))


def numbers(doc_id: int | None, seed: int) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(text: memoryview | bytes, h: list[int], rate: int, spm: int) -> tuple[PieceTable, str, int, tuple[int, int] | None]:
    """The arranged table of one document, its form, its number of lines, and the bytes before and behind its middle."""
    whole = PieceTable(text)
    ends = line_ends(text)
    n = len(ends)
    held = bytes(text)
    if n == 0 or h[2] % 100 >= rate or any(m in held for m in MARKS):
        return whole, "plain", n, None
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    form = "spm" if h[3] % 100 < spm else "psm"
    return whole.cut(a).cut(b).arranged(ARRANGEMENTS[form]), form, n, (a, b)


def read_back(output: memoryview | bytes, form: str) -> PieceTable:
    """The restored text as descriptors over an output, from the output and its form alone."""
    table = PieceTable(output)
    if form == "plain":
        return table
    order = ARRANGEMENTS[form]
    held, at = bytes(output), 0
    for k, part in enumerate(order):
        mark = MARKS[MARK_OF[part]]
        at = held.index(mark, at) if k else 0
        if held[at : at + len(mark)] != mark:
            raise ValueError(f"not an output of the form {form}")
        if k:
            table = table.cut(at)
        at += len(mark)
        table = table.cut(at)
    return table.restored(order)


def _bytes_of(column: pa.Array) -> Iterator[memoryview]:
    """Each value's UTF-8 bytes, without a copy; none for NULL."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    for value in column:
        yield memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")


def _added() -> list[T.StructField]:
    piece = T.StructType([T.StructField("buffer", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType())])
    types = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.ArrayType(piece), T.StringType())
    return [T.StructField(c, t) for c, t in zip(COLUMNS, types)]


PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("size", pa.int64())]))
SLICE = 1 << 22  # bytes of output between two record batches


def fill_in_middle(docs: DataFrame, seed: int, rate: int = 100, spm: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the number of lines, the form, the sizes of prefix and middle, the descriptors and the output.

    ``rate`` percent of the documents are rearranged, ``spm`` percent of those suffix first. ``pieces`` lists (buffer, start, size) in
    bytes, buffer 0 the text and 1 the sentinels ``<P><S><M>``.
    """
    small_batches(docs.sparkSession)
    docs = without_names(docs, COLUMNS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size, first = [], 0, 0
            for i, (doc, raw) in enumerate(zip(b.column(key).to_pylist(), _bytes_of(b.column(text)))):
                table, form, n, cuts = transformed(raw, numbers(doc, seed), rate, spm)
                chars = (None, None) if cuts is None else (code_points(raw[: cuts[0]]), code_points(raw[cuts[0] : cuts[1]]))
                rows.append((n, form, *chars, [(p.buffer, p.start, p.size) for p in table.pieces], table.render()))
                size += len(rows[-1][-1])
                if size >= SLICE or i + 1 == b.num_rows:
                    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), PIECES, pa.binary())
                    made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    made[-1] = made[-1].cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(rows)).columns, *made], [*b.schema.names, *COLUMNS])
                    rows, size, first = [], 0, i + 1

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *_added()]))


def digested(made: DataFrame) -> DataFrame:
    """``made`` (an output of ``fill_in_middle``) with the digests of each output and of the text restored from output and form."""
    added = ("output_sha256", "restored_sha256")
    made = without_names(made, added)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, back = [], []
            for form, raw in zip(b.column("form").to_pylist(), _bytes_of(b.column("output"))):
                whole.append(PieceTable(raw).digest())
                back.append(read_back(raw, form).digest())
            kept = [c for c in b.schema.names if c not in ("output", "pieces")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(whole, pa.string()), pa.array(back, pa.string())], [*kept, *added])

    fields = [f for f in made.schema.fields if f.name not in ("output", "pieces")]
    return made.mapInArrow(run, T.StructType([*fields, *(T.StructField(c, T.StringType()) for c in added)]))


def op13_piece_table(spark, sf_dir: str) -> DataFrame:
    """Every document cut by lines under seed 7, half of them suffix first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return digested(fill_in_middle(docs, seed=7).drop("text")).select(*columns)


QUERIES = {"op13_piece_table": op13_piece_table}

ORACLE = {
    "op13_piece_table": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
    string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), h AS (
  SELECT *, len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END AS n,
    CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
    CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), s AS (
  SELECT *,
    CASE WHEN a = 0 THEN '' WHEN a = n THEN text ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS prefix,
    CASE WHEN b = 0 THEN '' WHEN b = n THEN text ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS front FROM c
), p AS (
  SELECT *, substr(front, length(prefix) + 1) AS middle, substr(text, length(front) + 1) AS suffix FROM s
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
}
