"""Vectors in tasks: which take part, and groups of candidates that queries stream past."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_CHUNK = 256


def usable(vector: Column) -> Column:
    """Neither NULL nor empty, without NULL or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without NULLs as a float64 matrix; lists of different lengths are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of one table must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def streamed(candidates: DataFrame, queries: DataFrame, search: Callable, schema: str) -> DataFrame:
    """``search(candidates, queries)`` for every group, its queries in chunks of 256.

    ``candidates``: ``grp``, ``block``, ``id``, ``vec``; ``queries``: ``grp``, ``qno``, ``id``, ``vec``, ``floor``. A task holds the
    candidates of one group, which the caller bounds, and one chunk of queries; any number of queries streams past.
    ``search`` gets pyarrow tables, makes its index from the candidates once and yields record batches per chunk.
    """
    rows = candidates.select(
        "grp", F.lit(0).alias("kind"), "block", F.lit(None).cast("long").alias("qno"), "id", "vec", F.lit(None).cast("double").alias("floor")
    ).unionByName(queries.select("grp", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"), "qno", "id", "vec", "floor"))

    def chunks(batches) -> Iterator[pa.RecordBatch]:
        """Runs of one (group, kind), queries cut into chunks."""
        for b in batches:
            g, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "kind"))
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(k) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                step = QUERY_CHUNK if k[lo] == 1 else hi - lo
                for at in range(lo, hi, max(step, 1)):
                    yield b.slice(at, min(step, hi - at))

    def run(batches):
        group, held, index = None, [], None
        for run_of in chunks(batches):
            g, k = run_of.column("grp")[0].as_py(), run_of.column("kind")[0].as_py()
            if g != group:
                group, held, index = g, [], None
            if k == 0:
                held.append(run_of)
                continue
            if held and index is None:
                index = search(pa.Table.from_batches(held))
            if index is not None:
                yield from index(run_of, group)

    return rows.repartition("grp").sortWithinPartitions("grp", "kind", "block", "id").mapInArrow(run, schema)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]
