"""Equal texts collapsed before any work on their contents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.marks import BLOBS, U, bitmap, marked, members, packing
from tidemark.llm.rolling import mixed
from tidemark.session import written


def _hashes(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield mixed(b.column(0).to_numpy().view(U))


def without_names(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less its columns of these names, in any case: an operator's own columns take the place of the input's."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def untouched(rows: DataFrame, key: Column, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` (a 64-bit hash) is surely not in ``touched``, which stay where they are, and the others, for a join."""
    marks = members(touched)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(marked(h.to_numpy().view(U), marks))

    flag = F.coalesce(maybe(key), F.lit(True))
    return rows.where(~flag), rows.where(flag)


def first_copies(rows: DataFrame, order: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch], DataFrame]:
    """Rows of distinct texts, and which others equal them.

    ``rows`` has ``text`` (no NULLs), the number ``order`` and others. Returns:

    * ``once``, with ``text_hash`` added, and ``keep``, which its users' tasks apply to every batch of it first: what is left are, of rows
      with equal texts, the ones of the smallest ``order``.
    * the rows whose text occurs again, without the text: their columns, ``digest``, and ``first``, the smallest ``order`` of their text.

    ``keep.release()`` frees what ``keep`` and the third table read; call it when all that is made from them is stored.

    Texts whose 64-bit hash is not marked as occurring twice pass by unmoved. Only the others are grouped, by a 128-bit digest;
    one row for each text leaves a task, so a text that a third of all rows have is no burden.
    """
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    marks, _, _ = bitmap(hashed.select("text_hash").mapInArrow(packing(_hashes), BLOBS))

    def repeated(b: pa.RecordBatch) -> np.ndarray:
        h = b.column("text_hash")
        known = h.is_valid().to_numpy(zero_copy_only=False)
        return known & marked(mixed(h.fill_null(0).to_numpy().view(U)), marks)

    def keep(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(~repeated(b)))

    def others_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(repeated(b)))

    keep.release = marks.destroy

    again = hashed.mapInArrow(others_of, hashed.schema).drop("text_hash").withColumn("digest", F.md5(F.col("text").cast("binary")))
    fields = [order, *[c for c in rows.columns if c != order]]
    firsts = written(again.groupBy("digest").agg(F.min(F.struct(*fields)).alias("r")).select("digest", "r.*"))
    # A NULL hash is kept by every user.
    once = hashed.unionByName(firsts.select(*rows.columns, F.lit(None).cast("long").alias("text_hash")))
    others = again.drop("text").join(firsts.select("digest", F.col(order).alias("first")).hint("merge"), "digest")
    return once, keep, others
