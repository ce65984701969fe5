"""An index of log segments: which segment first reaches an instant, without reading the log.

A log is written in segments; stamps mostly rise along it, but rows may be stamped late or early. The index keeps, for each segment, its
place in the lineage (``ordinal``, oldest first) and the largest stamp in it (``reaches``), and above these a tree: a node of
level k covers 64 neighbouring nodes of level k - 1 and keeps the largest of their stamps. To find the first segment at or behind a place
that reaches an instant, a request meets the rest of its own node on every level, then goes down from the first that reaches: at most
64 nodes a level, each met by an equi-join. Nothing is joined with a lineage's whole log, nor with all of its segments.

The index is made by one aggregate over three columns of the log and has a row per segment (and a sixty-fourth more); keep it as a table
beside the log. Rows without a segment number are in no index; NULL stamps reach nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import ROWS_PER_TASK, latest, over_keys, total
from tidemark.session import written

FAN_BITS = 6


@dataclass(frozen=True)
class SegmentIndex:
    keys: list[str]
    leaves: DataFrame  # keys, seq, ordinal, reaches
    nodes: DataFrame  # keys, level, node, reaches; level 0 are the leaves
    levels: int


def segment_index(change_log: DataFrame, keys: Sequence[str] = ("lineage",), rows_per_task: int = ROWS_PER_TASK) -> SegmentIndex:
    """The index of ``change_log`` (keys, seq, ts). Without ``ts`` it only knows the segments."""
    keys = list(keys)
    stamp = F.col("ts") if "ts" in change_log.columns else F.lit(None).cast("timestamp")
    sums = change_log.where(F.col("seq").isNotNull()).groupBy(*keys, "seq").agg(F.max(stamp).alias("reaches"))
    place = {"_place": total(F.lit(1).cast("bigint"))}
    ranked = over_keys(written(sums), keys, ["seq"], lambda rows: rows.carry(**place).df.drop("_chunk"), rows_per_task)
    leaves = written(ranked.select(*keys, "seq", (F.col("_place") - 1).alias("ordinal"), "reaches"))
    last, levels = leaves.agg(F.max("ordinal")).first()[0] or 0, 1
    while last >> (FAN_BITS * levels):
        levels += 1
    nodes = leaves.select(*keys, F.lit(0).alias("level"), F.col("ordinal").alias("node"), "reaches")
    if levels > 1:
        upper = leaves.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels - 1))))
        upper = upper.groupBy(*keys, "level", _node(F.col("ordinal"), F.col("level")).alias("node")).agg(F.max("reaches").alias("reaches"))
        nodes = written(nodes.unionByName(upper))
    return SegmentIndex(keys, leaves, nodes, levels)


def _node(ordinal: Column, level: Column) -> Column:
    """The node of a level that covers an ordinal: ``ordinal`` div 64 ** level."""
    return F.call_function("shiftright", ordinal, (level * FAN_BITS).cast("int"))


def located(index: SegmentIndex, requests: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``requests`` (keys, request_id, start_seq, ...) with ``_first``, the ordinal of the first segment at or behind ``start_seq``,
    and ``_starts``: is that the start segment itself?"""
    keys, at = index.keys, F.col("start_seq")
    leaves = index.leaves.select(*keys, F.col("seq").alias("_at"), F.lit(0).alias("_kind"), F.struct("ordinal", "seq").alias("_leaf"))
    order = F.col("request_id").cast("string").alias("_id")
    asked = requests.select(*requests.columns, at.alias("_at"), F.lit(1).alias("_kind"), order)
    marks = leaves.unionByName(asked, allowMissingColumns=True)
    walked = over_keys(marks, keys, ["_at", "_kind", "_id"], lambda rows: rows.carry(_seen=latest(F.col("_leaf"))).where(F.col("_kind") == 1).df, rows_per_task)
    there = F.coalesce(F.col("_seen.seq") == at, F.lit(False))
    first = F.when(there, F.col("_seen.ordinal")).otherwise(F.coalesce(F.col("_seen.ordinal"), F.lit(-1).cast("bigint")) + 1)
    return walked.select(*requests.columns, first.alias("_first"), there.alias("_starts"))


def first_reaching(index: SegmentIndex, asked: DataFrame) -> DataFrame:
    """(request_id, ordinal) of the first segment at or behind ``place`` that reaches ``instant``, for ``asked`` (keys, request_id, place,
    instant); no row where none does."""
    keys = index.keys
    nodes = index.nodes.withColumn("_parent", F.shiftright("node", FAN_BITS))
    level = F.col("level")
    climbing = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(index.levels - 1))))
    climbing = climbing.withColumn("_own", _node(F.col("place"), level)).withColumn("_parent", F.shiftright("_own", FAN_BITS))
    met = climbing.join(nodes, [*keys, "level", "_parent"])
    ahead = (F.col("node") > F.col("_own")) | ((level == 0) & (F.col("node") == F.col("_own")))
    met = met.where(ahead & (F.col("reaches") >= F.col("instant")))
    found = met.groupBy(*keys, "request_id", "instant").agg(F.min(F.struct("level", "node")).alias("at"))
    found = found.select(*keys, "request_id", "instant", "at.level", "at.node")
    for upper in range(index.levels - 1, 0, -1):
        down = found.where(level == upper).select(*keys, "request_id", "instant", F.col("node").alias("_parent"))
        below = nodes.where(level == upper - 1).join(down, [*keys, "_parent"]).where(F.col("reaches") >= F.col("instant"))
        below = below.groupBy(*keys, "request_id", "instant").agg(F.min("node").alias("node")).withColumn("level", F.lit(upper - 1))
        found = found.where(level < upper).unionByName(below)
    return found.select("request_id", F.col("node").alias("ordinal"))


def replay_segments(index: SegmentIndex, placed: DataFrame) -> DataFrame:
    """A row for each segment of each of ``placed`` (a ``located`` request with ``_last``, the ordinal of its last segment, NULL for the end of
    the log): its columns and ``seq``."""
    keys = index.keys
    ends = index.leaves.groupBy(*keys).agg(F.max("ordinal").alias("_end"))
    rows = placed.join(ends, keys).withColumn("_last", F.coalesce("_last", "_end")).where(F.col("_first") <= F.col("_last"))
    rows = rows.withColumn("ordinal", F.explode(F.sequence("_first", "_last"))).drop("_end", "_first", "_last", "_starts")
    return rows.join(index.leaves.drop("reaches"), [*keys, "ordinal"]).drop("ordinal")


def stop_places(change_log: DataFrame, index: SegmentIndex, placed: DataFrame) -> DataFrame:
    """``placed`` requests (with ``start_pos``, ``target``) with ``stop``, the (seq, pos) of the first row at or behind the start that is stamped at
    or after the target's whole second, and ``_last``, its segment's ordinal; both NULL where no row is.

    Rows of at most two segments a request are read: the start segment, and the first behind it that reaches the target.
    """
    keys = index.keys
    instant = F.date_trunc("second", "target")
    behind = F.col("_first") + F.col("_starts").cast("bigint")
    later = first_reaching(index, placed.select(*keys, "request_id", behind.alias("place"), instant.alias("instant")))
    own = placed.where("_starts").select("request_id", F.col("_first").alias("ordinal"))
    tried = later.unionByName(own).join(placed.select(*keys, "request_id", "start_seq", "start_pos", instant.alias("instant")), "request_id")
    tried = tried.join(index.leaves.drop("reaches"), [*keys, "ordinal"])
    rows = change_log.select(*keys, "seq", "pos", "ts").join(tried, [*keys, "seq"])
    bounded = (F.col("seq") > F.col("start_seq")) | (F.col("pos") >= F.col("start_pos"))
    reached = rows.where(bounded & (F.col("ts") >= F.col("instant")))
    stops = reached.groupBy("request_id").agg(F.min(F.struct("seq", "pos", "ordinal")).alias("_s"))
    stops = stops.select("request_id", F.struct("_s.seq", "_s.pos").alias("stop"), F.col("_s.ordinal").alias("_last"))
    return placed.join(stops, "request_id", "left")
