"""Folding change logs into keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The last write of every key in log order; combined map-side, so a hot key is no burden."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in payload])


def fold(
    snapshot: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    op: str = "op",
) -> DataFrame:
    """Snapshot plus log in one aggregate. ``op = 'delete'`` removes a key.

    Every log row is later than the snapshot, whatever its order values, also NULL or negative ones.
    """
    none = F.lit(None).cast("bigint")
    base = snapshot.select(*keys, *payload, *[none.alias(c) for c in order], F.lit("upsert").alias(op), F.lit(0).alias("_side"))
    log = changes.select(*keys, *payload, *[F.col(c).cast("bigint").alias(c) for c in order], op, F.lit(1).alias("_side"))
    folded = latest_per_key(base.unionByName(log), keys, ["_side", *order], [op, *payload])
    return folded.where(F.col(op) != "delete").drop(op)


def apply_conflicts(replica: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Inserts that hit a key the replica already holds although no earlier log row touched it.

    Only a key's first log row can do that.
    """
    first = changes.groupBy(*keys).agg(
        F.min_by("op", F.struct(*order)).alias("op"), F.min(F.struct(*order)).alias("at")
    )
    inserts = first.where(F.col("op") == "insert").select(*keys, *[F.col(f"at.{c}").alias(c) for c in order])
    return inserts.join(replica.select(*keys).distinct(), list(keys), "left_semi")
