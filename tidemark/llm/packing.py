"""Best-fit packing of documents into sequences, under conflict constraints.

A sequence (bin) holds at most ``capacity`` tokens and never two pieces of one source or of one cluster of duplicates. A
document longer than a bin is cut into full pieces, each a bin of its own, and a remainder; nothing is dropped.

Pieces are numbered from the largest to the smallest (ties by a hash of the row) and dealt in turn into shares of about
``SHARE`` pieces, so every share has the same mix of sizes, and a source, cluster or copied row with a third of all rows is spread
evenly. A share is packed in one task, largest piece first. Open bins are kept in order of what is left in them, each with a bitmap
of its sources and clusters. For a piece the search starts at the successor of its size, the bin with the least room that
suffices, and goes on to the next bins until one has no bit in common with the piece: the tightest compatible bin. If
there is none, a new bin is opened. The search is not capped. A share's memory is its pieces' sizes and keys, about
``SHARE`` small rows; texts are not moved.

Bits are given within a share to sources and clusters that occur in it more than once; others cannot conflict.

The result has a row per piece: the input's columns without the text, ``piece`` (from 0), ``start`` and ``n_tokens`` of it in its
document, ``bin`` (unique) and ``offset`` in it. It depends on the rows and on their number, not on their order or partitions.

Edge cases: a NULL source or cluster conflicts with nothing; a NULL or negative size counts as 0 and takes part (such pieces
need no room but obey the constraints); repeated rows are packed each, apart by their cluster; an empty table gives an empty
result; the added columns replace input columns of their names, as do inner ones, whose names begin with two underscores.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.copies import without_names
from tidemark.llm.sharding import numbered

SHARE = 8192
CAPACITY = 16384
ADDED = ("piece", "start", "n_tokens", "bin", "offset", "row_number")


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every (size, source, cluster), packed in the given order."""
    keys = Counter((kind, key) for _, source, cluster in items for kind, key in ((0, source), (1, cluster)) if key is not None)
    bit: dict = {}
    for key, n in keys.items():
        if n > 1:
            bit[key] = 1 << len(bit)
    room: list[tuple[int, int]] = []  # (what is left, bin) in order
    marks: list[int] = []
    used: list[int] = []
    out = []
    for size, source, cluster in items:
        mask = bit.get((0, source), 0) | bit.get((1, cluster), 0)
        at = bisect_left(room, (size, -1))
        while at < len(room) and marks[room[at][1]] & mask:
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(marks)
            marks.append(0)
            used.append(0)
        out.append((b, used[b]))
        marks[b] |= mask
        used[b] += size
        insort(room, (left - size, b))
    return out


def packed(docs: DataFrame, size: str, source: str, cluster: str, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """``docs`` (rows travel whole: leave large columns out) cut into pieces and packed."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    inputs = docs.select(*docs.columns, F.col(size).alias("__size"), F.col(source).alias("__source"), F.col(cluster).alias("__cluster"))
    docs = without_names(inputs, (*ADDED, "__share", "__n", "__less"))
    n = F.greatest(F.coalesce(F.col("__size").cast("long"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0))
    pieces = docs.withColumn("__n", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("start", F.col("piece") * capacity)
    pieces = pieces.withColumn("n_tokens", F.least(F.col("__n") - F.col("start"), F.lit(capacity))).drop("__n")
    numbers, total = numbered(pieces.withColumn("__less", -F.col("n_tokens")), ["__less"])
    shares = -(-max(total, 1) // share)
    dealt = numbers.drop("__less").withColumn("__share", F.pmod("row_number", F.lit(shares)))
    names = [c for c in pieces.columns if c not in ("__size", "__source", "__cluster")]
    schema = T.StructType([*pieces.select(names).schema.fields, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType())])
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            shares_of = b.column("__share").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shares_of)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and shares_of[lo] != now:
                    yield from placed(held)
                    held, now = [], shares_of[lo]
                held.append(b.slice(lo, hi - lo))
        yield from placed(held)

    def placed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        items = list(zip(*(table.column(c).to_pylist() for c in ("n_tokens", "__source", "__cluster"))))
        bins = best_fit(items, capacity)
        number = table.column("__share")[0].as_py() << 32
        table = table.select(names).append_column("bin", pa.array([number + b for b, _ in bins], pa.int64()))
        yield from table.append_column("offset", pa.array([o for _, o in bins], pa.int64())).to_batches()

    return dealt.repartition("__share").sortWithinPartitions("__share", "row_number").mapInArrow(run, schema)


def measured(docs: DataFrame) -> DataFrame:
    """Size (UTF-8 bytes, which are the tokens of a byte-level model, and one for the end of the document) and cluster of texts."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    return docs.select("doc_id", "source", size, F.when(F.col("text").isNotNull(), F.md5(text.cast("binary"))).alias("cluster"))


def op3_conflict_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 16,384 byte tokens."""
    docs = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed(docs, "size", "source", "cluster").select("doc_id", "source", "cluster", "piece", "start", "n_tokens", "bin", "offset")


QUERIES = {"op3_conflict_best_fit": op3_conflict_best_fit}
