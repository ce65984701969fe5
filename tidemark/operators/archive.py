"""Archive upkeep and log-range rules. Log order is always the numeric ``seq``.

Tables: segments(archive_id, lineage, seq, name, last_ts) · ledger(lineage, name, status) ·
active(lineage, active_seq) · fulls(archive_id, lineage, dump_key, taken_at, start_file,
start_seq, start_pos) · targets(archive_id, request_id, target) · change_log(lineage, seq,
pos, ts, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.ordered import ROWS_PER_TASK, Ordered, latest, over_keys, previous, total
from tidemark.operators.log_index import SegmentIndex, located, replay_segments, segment_index, stop_places
from tidemark.session import written

# Cadence defaults in seconds.
FULL_INTERVAL_S = 86400
ROTATE_INTERVAL_S = 60


def numbered_segments(segments: DataFrame) -> DataFrame:
    """Segments whose name carries a number; the others never enter order or gap rules."""
    return segments.where(F.col("seq").isNotNull())


def segment_rejects(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("seq").isNull())


def segment_order(segments: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds ``position``, 1-based, oldest first by number."""
    return over_keys(
        numbered_segments(segments),
        ["lineage"],
        ["seq", "name"],
        lambda rows: rows.carry(position=total(F.lit(1).cast("bigint"))).df.drop("_chunk"),
        rows_per_task,
    )


def closed_segments(segments: DataFrame, active: DataFrame) -> DataFrame:
    """Segments strictly older than the one being written."""
    return segments.join(active, "lineage").where(F.col("seq") < F.col("active_seq"))


def from_coordinate(seq: Column, pos: Column, start_seq: Column, start_pos: Column) -> Column:
    """The start position only bounds the start segment; later segments are taken whole."""
    return (seq > start_seq) | ((seq == start_seq) & (pos >= start_pos))


def start_coordinate_filter(change_log: DataFrame, requests: DataFrame, index: SegmentIndex | None = None) -> DataFrame:
    """Log rows each request replays: (request columns) x (its lineage's rows, in its archive, from the start on).

    Requests meet the log by segment, so rows before the start segment are not joined. ``index`` is the log's, made here if it is not kept.
    """
    index = index or segment_index(change_log, lineage_keys(change_log, requests))
    placed = located(index, requests).withColumn("_last", F.lit(None).cast("bigint"))
    return _replayed(change_log, index, placed)


def _replayed(change_log: DataFrame, index: SegmentIndex, placed: DataFrame) -> DataFrame:
    """The rows of each placed request's segments from its start on; one equi-join on the segment."""
    reach = from_coordinate(F.col("seq"), F.col("pos"), F.col("start_seq"), F.col("start_pos"))
    return change_log.join(replay_segments(index, placed), [*index.keys, "seq"]).where(reach)


def newest_full_asof(targets: DataFrame, fulls: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each target with the newest backup of its archive taken at or before it.

    Targets without one keep NULLs. Backups of the same instant: the greatest lineage.
    """
    picked = ["lineage", "dump_key", "taken_at", "start_file", "start_seq", "start_pos"]
    backup_rows = fulls.select(
        "archive_id",
        F.unix_micros("taken_at").alias("at"),
        F.lit(0).alias("side"),
        F.col("lineage").alias("tie"),
        F.lit(None).cast("string").alias("request_id"),
        F.lit(None).cast("timestamp").alias("target"),
        F.struct(*picked).alias("full"),
    )
    target_rows = targets.select(
        "archive_id",
        F.unix_micros("target").alias("at"),
        F.lit(1).alias("side"),
        F.col("request_id").alias("tie"),
        "request_id",
        "target",
        F.lit(None).cast(backup_rows.schema["full"].dataType).alias("full"),
    )
    return over_keys(
        backup_rows.unionByName(target_rows),
        ["archive_id"],
        ["at", "side", "tie"],
        lambda rows: rows.carry(pick=latest(F.col("full")))
        .where(F.col("side") == 1)
        .df.select("archive_id", "request_id", "target", *[F.col(f"pick.{c}").alias(c) for c in picked]),
        rows_per_task,
    )


def fallback_fulls(fulls: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The archive's backups, newest first then by lineage, as the lines an error report lists.

    A report for a selected backup shows this list without the selected ``dump_key``;
    ``others`` is its length then, and 0 stands for "none". The list is built once per
    archive, not once per request.
    """
    ranked = over_keys(
        fulls.withColumn("newest", -F.unix_micros("taken_at")),
        ["archive_id"],
        ["newest", "lineage", "dump_key"],
        lambda rows: rows.carry(rank=total(F.lit(1).cast("bigint"))).df,
        rows_per_task,
    )
    sizes = fulls.groupBy("archive_id").agg((F.count(F.lit(1)) - 1).alias("others"))
    line = F.concat(
        F.lit("server-"), "lineage", F.lit(" full taken at "), X.format_rfc3339_millis(F.col("taken_at"))
    )
    return ranked.join(sizes, "archive_id").select("archive_id", "dump_key", "rank", "others", line.alias("line"))


def _not_recorded(segments: DataFrame, ledger: DataFrame) -> DataFrame:
    return segments.join(ledger.where(F.col("status").isin("uploaded", "lost")), ["lineage", "name"], "left_anti")


def pending_uploads(index: DataFrame, active: DataFrame, ledger: DataFrame, disk: DataFrame) -> DataFrame:
    """Closed segments still to be shipped: on disk, neither uploaded nor lost."""
    closed = closed_segments(index, active).drop("active_seq")
    return _not_recorded(closed, ledger).join(disk.select("lineage", "name"), ["lineage", "name"], "left_semi")


def lost_segments(index: DataFrame, active: DataFrame, ledger: DataFrame, disk: DataFrame) -> DataFrame:
    """Closed segments that left the disk before they were shipped and are not yet reported."""
    closed = closed_segments(index, active).drop("active_seq")
    return _not_recorded(closed, ledger).join(disk.select("lineage", "name"), ["lineage", "name"], "left_anti")


def upload_reconcile(ledger: DataFrame, listing: DataFrame, checks: DataFrame) -> DataFrame:
    """Upload records with ``keep``: false only where the archive was checked and lacks the object."""
    uploads = ledger.where(F.col("status") == "uploaded")
    present = listing.select("lineage", "name").distinct().withColumn("present", F.lit(True))
    looked = F.coalesce("checked", F.lit(False))
    return (
        uploads.join(present, ["lineage", "name"], "left")
        .join(checks.select("lineage", "checked"), "lineage", "left")
        .select("lineage", "name", (~looked | F.col("present").isNotNull()).alias("keep"))
    )


def lineage_keys(*tables: DataFrame) -> list[str]:
    """What names a log: its lineage, within its archive where all tables name that."""
    return [c for c in ("archive_id", "lineage") if all(c in t.columns for t in tables)]


def replay_plan(segments: DataFrame, starts: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The gap-free run from each start(archive_id, lineage, start_seq, start_file) and the gap that ends it.

    Where both tables name the archive, runs stay within it: a copy of a lineage in another archive fills no hole.
    One backward walk over a lineage's segments and starts together: a start meets the end of
    its run and whatever lies past it, so nothing grows with starts x segments. Two segments
    of the same number are a gap, also under one name. A start that is not archived has an empty run, and a gap
    when anything of a higher number exists.
    """
    keys = lineage_keys(segments, starts)
    no_name, no_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    copies = numbered_segments(segments).groupBy(*keys, "seq", "name").agg(
        F.count(F.lit(1)).alias("copies"), F.max("last_ts").alias("last_ts")
    )
    archived = copies.select(
        *keys, "seq", F.lit(0).alias("above"), "name", F.lit(1).alias("side"), "last_ts", no_name.alias("start_file"), "copies"
    )
    # Each start looks twice: at its own place, and just above every segment of its number.
    looks = F.array(
        F.struct(F.lit(0).alias("above"), F.col("start_file").alias("name")),
        F.struct(F.lit(1).alias("above"), F.lit("").alias("name")),
    )
    looking = (
        starts.select(*keys, "start_seq", "start_file").distinct().withColumn("look", F.explode(looks))
        .select(*keys, F.col("start_seq").alias("seq"), "look.above", "look.name", F.lit(0).alias("side"), no_time.alias("last_ts"), "start_file", F.lit(0).cast("bigint").alias("copies"))
    )
    is_segment = F.col("side") == 1

    def walk(rows: Ordered) -> DataFrame:
        rows = rows.carry(newer=previous(F.when(is_segment, F.struct("seq", "name"))))
        twice = F.col("copies") > 1
        ends = is_segment & (twice | F.coalesce(F.col("newer.seq") != F.col("seq") + 1, F.lit(True)))
        past = F.when(twice, F.col("name")).otherwise(F.col("newer.name"))
        end = F.struct("seq", "name", "last_ts", past.alias("past"))
        rows = rows.columns(_end=F.when(ends, end)).carry(end=latest(F.col("_end")))
        own, met = F.col("above") == 0, F.col("newer")
        here = own & F.coalesce((met["seq"] == F.col("seq")) & (met["name"] == F.col("start_file")), F.lit(False))
        return rows.where(~is_segment).df.select(
            *keys,
            F.col("seq").alias("start_seq"),
            "start_file",
            F.when(here, F.col("end")).alias("end"),
            F.when(~own, met["name"]).alias("higher"),
        )

    found = over_keys(
        archived.unionByName(looking), keys, ["seq", "above", "name", "side"], walk, rows_per_task, backward=True
    )
    start_key = [*keys, "start_seq", "start_file"]
    merged = found.groupBy(*start_key).agg(F.max("end").alias("end"), F.max("higher").alias("higher"))
    here = F.col("end").isNotNull()
    return merged.select(
        *start_key,
        F.when(here, F.col("end.seq") - F.col("start_seq") + 1).otherwise(F.lit(0)).alias("run_length"),
        F.col("end.name").alias("run_last"),
        F.col("end.last_ts").alias("run_last_ts"),
        F.when(here & F.col("end.past").isNotNull(), F.col("end.name"))
        .when(~here & F.col("higher").isNotNull(), F.lit(""))
        .alias("gap_after"),
        F.when(here, F.col("end.past")).otherwise(F.col("higher")).alias("gap_next"),
    )


def purge_cut(disk: DataFrame, active: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per lineage the segment before which everything may be reclaimed; NULL when nothing may."""
    safe = ledger.where(F.col("status").isin("uploaded", "lost")).select("lineage", "name").distinct()
    seen = (
        disk.join(safe.withColumn("safe", F.lit(True)), ["lineage", "name"], "left")
        .join(active, "lineage")
        .withColumn("blocks", (F.col("seq") == F.col("active_seq")) | F.col("safe").isNull())
    )
    at = F.struct("seq", "name")
    ends = seen.groupBy("lineage").agg(
        F.min(at).alias("oldest"), F.min(F.when(F.col("blocks"), at)).alias("boundary")
    )
    cut = F.when(F.col("boundary") > F.col("oldest"), F.col("boundary"))
    return ends.select("lineage", cut.getField("seq").alias("cut_seq"), cut.getField("name").alias("cut"))


def ledger_after_purge(ledger: DataFrame, cuts: DataFrame) -> DataFrame:
    """The ledger without upload records of reclaimed segments; loss records stay."""
    seq = X.log_seq(F.col("name"))
    purged = F.coalesce((F.col("status") == "uploaded") & (seq < F.col("cut_seq")), F.lit(False))
    return ledger.join(cuts.select("lineage", "cut_seq"), "lineage", "left").where(~purged).drop("cut_seq")


def stop_cut(change_log: DataFrame, requests: DataFrame, index: SegmentIndex | None = None) -> DataFrame:
    """Log rows each request(request_id, lineage, start_seq, start_pos, target) replays, up to its stop.

    Replay ends at the first row, in log order, stamped at or after the target's whole second. Later rows stay out even when stamped
    earlier. The log's index tells in which segment that is, rows of two segments at most where in it; the requests are stored with
    their stops and meet the log once, by segment. No row behind the stop's segment is joined.
    """
    index = index or segment_index(change_log, lineage_keys(change_log, requests))
    bounded = written(stop_places(change_log, index, written(located(index, requests))))
    replayed = _replayed(change_log, index, bounded)
    return replayed.where(F.col("stop").isNull() | (F.struct("seq", "pos") < F.col("stop"))).drop("stop")


def segment_coverage(headers: DataFrame) -> DataFrame:
    """Time of the last header in each segment, by place in the log, not the largest."""
    return headers.groupBy("lineage", "seq").agg(F.max_by("ts", "pos").alias("covered_to"))


def needs_full_backup(
    lineages: DataFrame, fulls: DataFrame, as_of: Column, interval_s: int = FULL_INTERVAL_S
) -> DataFrame:
    """When each lineage's next full backup is due; one without any is due at once."""
    newest = fulls.groupBy("lineage").agg(F.max("taken_at").alias("last_full"))
    due = F.col("last_full") + F.make_dt_interval(secs=F.lit(interval_s))
    return (
        lineages.select("lineage").distinct().join(newest, "lineage", "left")
        .select("lineage", "last_full", due.alias("due_at"), F.coalesce(due <= as_of, F.lit(True)).alias("due"))
    )


def cadence_overdue(
    segments: DataFrame,
    fulls: DataFrame,
    as_of: Column,
    rotate_s: int = ROTATE_INTERVAL_S,
    full_s: int = FULL_INTERVAL_S,
) -> DataFrame:
    """Lineages whose newest segment or newest full backup is older than its cadence allows."""
    rotated = segments.groupBy("lineage").agg(F.max("last_ts").alias("last_segment"))
    backed = fulls.groupBy("lineage").agg(F.max("taken_at").alias("last_full"))
    late = lambda at, s: F.coalesce(
        F.col(at) + F.make_dt_interval(secs=F.lit(s)) < as_of, F.lit(True)
    )
    return rotated.join(backed, "lineage", "full").select(
        "lineage",
        "last_segment",
        "last_full",
        late("last_segment", rotate_s).alias("rotation_overdue"),
        late("last_full", full_s).alias("full_overdue"),
    )


def lag_bound_seconds(rotate_s: Column) -> Column:
    """How far an achieved point may trail its target: two rotations and a minute, saturating."""
    wide = rotate_s.cast("decimal(38,0)") * F.lit(2).cast("decimal(1,0)") + F.lit(60).cast("decimal(2,0)")
    return F.least(wide, F.lit(9223372036854775807).cast("decimal(38,0)")).cast("bigint")


def recovery_bound(points: DataFrame) -> DataFrame:
    """(target, achieved, rotate_s) with the lag, its bound and the verdict. Past the target is fine."""
    lag = X.whole_seconds_between(F.col("achieved"), F.col("target"))
    bound = lag_bound_seconds(F.col("rotate_s"))
    return points.withColumns({"lag_s": lag, "bound_s": bound, "within": lag <= bound})
