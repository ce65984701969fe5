"""Running state per key in a given order, without ever giving a hot key to one task.

Most rules in this library are of the form "walk one node's (or one lineage's) rows in
order and remember something": the previous value, when a condition began, a running
count. Spark's window does that well while a key fits into one task. Rows of keys with more than
``rows_per_task`` rows are range-partitioned by key and whole order, so that bursts and runs of equal clock values are
split by their real number, and stored once with their partition as chunk. Each chunk is summed up by an ordinary
aggregate (combined map-side), the summaries of a key are walked by a small window, and what they carry is joined back
to the chunk's rows. A carry that reads what an earlier one remembered works on rows stored with it, so each is read twice,
once for its summaries and once for its rows, however many carries a rule chains. Both plans give the same rows; NULLs come first in
the order and are keys like any other.

``over_keys`` counts rows per key first (combined map-side) and asks for the keys above the
bound. Usually there are none and the plan is the plain window. Up to ``BROADCAST_KEYS`` hot
keys are broadcast; beyond that they are joined like any other table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

ROWS_PER_TASK = 4_000_000
BROADCAST_KEYS = 10_000
_CHUNK = "_chunk"


@dataclass(frozen=True)
class Carry:
    """One remembered value: how rows combine, and whether the current row takes part."""

    kind: str
    value: Column
    inclusive: bool = True


def total(value: Column, inclusive: bool = True) -> Carry:
    return Carry("total", value, inclusive)


def lowest(value: Column, inclusive: bool = True) -> Carry:
    return Carry("lowest", value, inclusive)


def highest(value: Column, inclusive: bool = True) -> Carry:
    return Carry("highest", value, inclusive)


def latest(value: Column, inclusive: bool = True) -> Carry:
    """The last non-null value seen."""
    return Carry("latest", value, inclusive)


def toggled(value: Column, inclusive: bool = True) -> Carry:
    """The bits that an odd number of rows had set."""
    return Carry("toggled", value, inclusive)


def previous(value: Column) -> Carry:
    """The last non-null value strictly before the row."""
    return Carry("latest", value, False)


class Ordered:
    """Rows of ``df`` seen per ``keys`` in ``order``, or against it. ``order`` must be total within a key."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[Column],
        chunk: str | None = None,
        backward: bool = False,
        carried: bool = False,
    ):
        self.df, self.keys, self.order, self.chunk, self.backward = df, list(keys), list(order), chunk, backward
        self.carried = carried  # do rows hold what is not stored yet?

    def _with(self, df: DataFrame, carried: bool | None = None) -> Ordered:
        return Ordered(df, self.keys, self.order, self.chunk, self.backward, self.carried if carried is None else carried)

    def _directed(self, columns: Sequence[Column]) -> list[Column]:
        return [c.desc() if self.backward else c.asc() for c in columns]

    def columns(self, **cols: Column) -> Ordered:
        return self._with(self.df.withColumns(cols))

    def where(self, condition: Column) -> Ordered:
        return self._with(self.df.where(condition))

    def carry(self, **carries: Carry) -> Ordered:
        """Add one column per carry."""
        if self.chunk is None:
            return self._with(self.df.withColumns({n: self._window(c, self.keys) for n, c in carries.items()}))
        if self.carried:
            return self._with(written(self.df), False).carry(**carries)
        groups = [*self.keys, self.chunk]
        summary = self.df.groupBy(*groups).agg(*[self._summary(c).alias(f"_in_{n}") for n, c in carries.items()])
        earlier = Window.partitionBy(*self.keys).orderBy(*self._directed([F.col(self.chunk)]))
        earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
        handed = summary.select(
            *[F.col(g).alias(f"_of_{g}") for g in groups],
            *[_fold(c.kind)(F.col(f"_in_{n}")).over(earlier).alias(f"_in_{n}") for n, c in carries.items()],
        )
        joined = self.df.join(handed, _same(groups)).drop(*[f"_of_{g}" for g in groups])
        own = {n: _merge(c.kind, F.col(f"_in_{n}"), self._window(c, groups)) for n, c in carries.items()}
        return self._with(joined.withColumns(own).drop(*[f"_in_{n}" for n in carries]), True)

    def _window(self, carry: Carry, keys: Sequence[str]) -> Column:
        frame = Window.partitionBy(*keys).orderBy(*self._directed(self.order))
        frame = frame.rowsBetween(Window.unboundedPreceding, 0 if carry.inclusive else -1)
        return _fold(carry.kind)(carry.value).over(frame)

    def _summary(self, carry: Carry) -> Column:
        if carry.kind == "latest":
            newest = F.min_by if self.backward else F.max_by
            return newest(carry.value, F.when(carry.value.isNotNull(), F.struct(*self.order)))
        return _fold(carry.kind)(carry.value)


def _fold(kind: str) -> Callable[[Column], Column]:
    folds = {"total": F.sum, "lowest": F.min, "highest": F.max, "toggled": F.bit_xor, "latest": lambda c: F.last(c, ignorenulls=True)}
    return folds[kind]


def _merge(kind: str, handed: Column, own: Column) -> Column:
    if kind == "total":
        return F.when(handed.isNull() & own.isNull(), None).otherwise(
            F.coalesce(handed, F.lit(0)) + F.coalesce(own, F.lit(0))
        )
    if kind == "toggled":
        return F.coalesce(handed, F.lit(0)).bitwiseXOR(F.coalesce(own, F.lit(0)))
    best = {"lowest": F.least, "highest": F.greatest, "latest": lambda early, late: F.coalesce(late, early)}
    return best[kind](handed, own)


def _same(columns: Sequence[str]) -> Column:
    """Rows agree with the columns' copies named ``_of_...``, NULLs with NULLs."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns])


def none_above(df: DataFrame, keys: Sequence[str], rows: int) -> bool:
    """Does every key have at most ``rows`` rows? One aggregate over the key columns."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > rows).limit(1).count() == 0


def over_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable[[Ordered], DataFrame],
    rows_per_task: int = ROWS_PER_TASK,
    known_small: bool = False,
    backward: bool = False,
) -> DataFrame:
    """``build`` over each key's rows: one window stage, plus a chunked branch if keys are hot.

    Counts rows per key first, which runs ``df`` once for its key columns, unless the caller
    has shown on something cheaper that no key is above the bound. ``backward`` walks from the
    last row to the first.
    """
    columns = [F.col(c) for c in order]
    if known_small:
        return build(Ordered(df, keys, columns, None, backward))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task)
    hot = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_n")
    found = hot.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return build(Ordered(df, keys, columns, None, backward))
    rows = sum(r["_n"] for r in found)
    if len(found) <= BROADCAST_KEYS:
        hot = F.broadcast(df.sparkSession.createDataFrame(found, hot.schema))
    else:
        rows = hot.agg(F.sum("_n")).first()[0]
    cold = df.join(hot, _same(keys), "left_anti")
    spread = df.join(hot, _same(keys), "left_semi").repartitionByRange(-(-rows // rows_per_task) + 1, *keys, *columns)
    chunked = written(spread.withColumn(_CHUNK, F.spark_partition_id()))
    plain = build(Ordered(cold, keys, columns, None, backward))
    return plain.unionByName(build(Ordered(chunked, keys, columns, _CHUNK, backward)).select(*plain.columns))
