"""Reproducible shuffle into shards: a Feistel permutation over global row numbers, DataFrame operations only.

Row numbers are 0..n-1 in the order of the given columns. A Feistel network over Z_a x Z_b (a*b >= n, barely larger)
permutes them; results at or above n go through it again until they fall below n (cycle walking). The permuted position
p gives shard p mod shards and slot p div shards, so shard sizes differ by one row at most, slots have no gaps, and
whoever knows (n, seed, shards) computes from a row number where the row lies (``place``), and from a place which row
lies there (``row_at``), without any table.

Edge cases: NULLs sort first in the row order; rows equal in the order columns are ordered by a hash of all their
columns, and rows equal in all columns are interchangeable; an empty table gives an empty result; an input column named
like an added one is refused by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.copies import without_names
from tidemark.session import written

ROUNDS = 6
ADDED = ("row_number", "position", "shard", "slot")


def sides(n: int) -> tuple[int, int]:
    """The two moduli of the network: a*b >= n and a*b - n < a, a about the square root of n."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _mixed(value: Column, r: int, seed: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), F.lit(r).cast("long"), value), F.lit(modulus).cast("long"))


def _div(x: Column, y: int) -> Column:
    return F.call_function("div", x, F.lit(y).cast("long"))


def _forward(x: Column, n: int, seed: int) -> Column:
    a, b = sides(n)
    left, right = _div(x, b), F.pmod(x, F.lit(b).cast("long"))
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + _mixed(right, r, seed, a), F.lit(a).cast("long"))
        else:
            right = F.pmod(right + _mixed(left, r, seed, b), F.lit(b).cast("long"))
    return left * F.lit(b).cast("long") + right


def _backward(x: Column, n: int, seed: int) -> Column:
    a, b = sides(n)
    left, right = _div(x, b), F.pmod(x, F.lit(b).cast("long"))
    for r in reversed(range(ROUNDS)):
        if r % 2 == 0:
            left = F.pmod(left - _mixed(right, r, seed, a), F.lit(a).cast("long"))
        else:
            right = F.pmod(right - _mixed(left, r, seed, b), F.lit(b).cast("long"))
    return left * F.lit(b).cast("long") + right


def _walked(x: Column, n: int, step) -> Column:
    """``step`` until the value is below n.

    Values at or above n number fewer than a = ceil(sqrt(n)), and a walk visits each once at most. Up to n = 4096 the
    64 steps below therefore always suffice; beyond, a walk longer than that has a chance under n * 64**-64, and
    would end the job with a message instead of giving a wrong place.
    """
    first = step(x, n)
    again = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), first, lambda at, _: F.when(at < F.lit(n), at).otherwise(step(at, n))
    )
    last = F.when(first < F.lit(n), first).otherwise(again)
    return F.when(last < F.lit(n), last).otherwise(F.raise_error(F.lit("cycle walk exceeded its bound")).cast("long"))


def position_of(row_number: Column, n: int, seed: int = 0) -> Column:
    """The permuted position of a row number among ``n`` rows."""
    return _walked(row_number.cast("long"), n, lambda x, m: _forward(x, m, seed))


def place(row_number: Column, n: int, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """(shard, slot) of a row number."""
    position = position_of(row_number, n, seed)
    return F.pmod(position, F.lit(shards)).cast("int"), _div(position, shards)


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """The row number that lies at a place: the permutation walked backward."""
    return _walked((slot * shards + shard).cast("long"), n, lambda x, m: _backward(x, m, seed))


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with its global ``row_number`` from 0 in the order of ``order``, and the number of rows.

    Rows are range-partitioned by the whole order plus a tie-breaker, so that a third of all rows under one key splits,
    sorted, and stored once with their place in the partition; the partitions' counts, one small row each, give the
    offsets. The numbers depend on the rows alone, not on partition bounds.
    """
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [*[F.col(c) for c in order], F.xxhash64(*hashable), F.col("__tie")]
    spread = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    stored = written(spread.sortWithinPartitions(*keys).drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted(map(tuple, stored.groupBy(part.alias("p")).count().collect()))  # a row per partition
    starts, n = [], 0
    for p, rows in counts:
        starts.append((p, n))
        n += rows
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    placed = stored.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row per partition
    number = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("row_number", number).drop("__part", "__start", "__at"), n


def feistel_shards(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``row_number``, its permuted ``position``, ``shard`` and gapless ``slot``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    df = without_names(df, (*ADDED, "__tie", "__at", "__part", "__start"))
    rows, n = numbered(df, order)
    rows = rows.withColumn("position", position_of(F.col("row_number"), n, seed))
    return rows.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn("slot", _div(F.col("position"), shards))


def op7_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return feistel_shards(rows, ["doc_id"], shards=8, seed=17).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op7_feistel_shards": op7_feistel_shards}
