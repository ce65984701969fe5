"""Registered queries on archives and change logs."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import archive as A
from tidemark.operators import replay as R
from tidemark.plans import recovery
from tidemark.plans.tables import BASE_PATH, Tables, text
from tidemark.session import new_path, written
from tidemark.sources import archive as S
from tidemark.streaming.live_table import LiveTable


def newest_moment(t: Tables) -> Column:
    """Two hours after the last change: the instant upkeep reports are made for."""
    last = t.change_log.agg(F.max("ts") + F.expr("interval 2 hours"))
    return last.scalar()


def archive_listing(t: Tables) -> DataFrame:
    return S.archive_listing(t.objects, BASE_PATH)


def full_backup_scan(t: Tables) -> DataFrame:
    return S.full_backup_scan(t.backup_texts, BASE_PATH)


def full_backup_rejects(t: Tables) -> DataFrame:
    return S.full_backup_rejects(t.backup_texts, BASE_PATH)


def segment_index_scan(t: Tables) -> DataFrame:
    line = (
        F.when(F.col("status") == "lost", "   ")
        .when(F.col("seq") % 2 == 0, F.concat(F.lit("./"), "name", F.lit("  ")))
        .otherwise(F.col("name"))
    )
    return S.segment_index_scan(t.segments.select("lineage", line.alias("line")))


def event_header_scan(t: Tables) -> DataFrame:
    stamp = F.concat(F.lit("#"), F.date_format("ts", "yyMMdd"), F.lit(" "))
    tail = text(" server id 1  end_log_pos ", F.col("pos"))
    padded = F.concat(stamp, F.lpad(F.hour("ts").cast("string"), 2, " "), F.date_format("ts", ":mm:ss"), tail)
    plain = F.concat(stamp, F.date_format("ts", "HH:mm:ss"), tail)
    line = (
        F.when(F.col("image") < 1, F.concat(F.lit("#700101  0:00:00"), tail))
        .when(F.col("op") == "delete", text("# at ", F.col("pos")))
        .when(F.col("op") == "insert", padded)
        .otherwise(plain)
    )
    # The explode keeps the text from being built again for every place that reads it.
    return S.event_header_scan(t.change_log.select("lineage", "seq", "pos", F.explode(F.array(line)).alias("line")))


def dump_coordinate_scan(t: Tables) -> DataFrame:
    named = F.concat(F.lit("-- CHANGE REPLICATION SOURCE TO SOURCE_LOG_FILE='"), "start_file", F.lit("'"))
    older = F.concat(F.lit("CHANGE MASTER TO MASTER_LOG_FILE='"), "start_file", F.lit("'"))
    head = (
        F.when(F.col("archive_id") == "a2", F.concat(named, F.lit(";")))
        .when(F.col("archive_id") == "a1", F.concat(older, text(", MASTER_LOG_POS=", F.col("start_pos"), ";")))
        .otherwise(F.concat(named, text(", SOURCE_LOG_POS=", F.col("start_pos"), ";")))
    )
    later = F.lit("-- CHANGE MASTER TO MASTER_LOG_FILE='binlog.999999', MASTER_LOG_POS=4;")
    lines = t.fulls.select(
        F.col("dump_key").alias("file"),
        F.posexplode(F.array(F.lit("-- dump"), head, later)).alias("line_no", "line"),
    )
    return S.dump_coordinate_scan(lines)


def closed_segments(t: Tables) -> DataFrame:
    return A.closed_segments(t.segments.select("lineage", "seq", "name"), t.active)


def _chosen(t: Tables) -> DataFrame:
    """The requests with their backups, stored: their size then decides how they join the log."""
    return written(A.newest_full_asof(t.targets, t.fulls))


def start_coordinate_filter(t: Tables) -> DataFrame:
    rows = A.start_coordinate_filter(t.change_log, _chosen(t))
    return rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("seq") * 250 + F.col("pos")).alias("first_at")
    )


def newest_full_asof(t: Tables) -> DataFrame:
    return A.newest_full_asof(t.targets, t.fulls)


def fallback_fulls(t: Tables) -> DataFrame:
    return A.fallback_fulls(t.fulls)


def pending_uploads(t: Tables) -> DataFrame:
    return A.pending_uploads(t.segments.select("lineage", "seq", "name"), t.active, t.ledger, t.disk)


def lost_segments(t: Tables) -> DataFrame:
    return A.lost_segments(t.segments.select("lineage", "seq", "name"), t.active, t.ledger, t.disk)


def upload_reconcile(t: Tables) -> DataFrame:
    """Uploads of hour 3 were cut off and lie under a temporary name."""
    named = F.when(F.hour("first_ts") == 3, F.concat("name", F.lit(".part"))).otherwise(F.col("name"))
    listing = t.archived.select("lineage", named.alias("name"))
    checks = t.active.select("lineage", (F.col("lineage") != "n5").alias("checked"))
    return A.upload_reconcile(t.ledger, listing, checks)


def segment_order(t: Tables) -> DataFrame:
    return A.segment_order(t.segments.select("lineage", "seq", "name"))


def replay_plan(t: Tables) -> DataFrame:
    return A.replay_plan(t.archived, t.fulls).drop("archive_id")


def purge_cut(t: Tables) -> DataFrame:
    return A.purge_cut(t.disk, t.active, t.ledger)


def ledger_after_purge(t: Tables) -> DataFrame:
    return A.ledger_after_purge(t.ledger, A.purge_cut(t.disk, t.active, t.ledger))


def stop_cut(t: Tables) -> DataFrame:
    rows = A.stop_cut(t.change_log_late, _chosen(t))
    return rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("seq") * 250 + F.col("pos")).alias("last_at")
    )


def segment_coverage(t: Tables) -> DataFrame:
    return A.segment_coverage(t.change_log_late)


def needs_full_backup(t: Tables) -> DataFrame:
    """Active lineages, and for each a spare one that has no backup yet."""
    spare = t.active.withColumn("lineage", F.concat(F.lit("spare-"), "lineage"))
    return A.needs_full_backup(t.active.unionByName(spare), t.fulls, newest_moment(t))


def cadence_overdue(t: Tables) -> DataFrame:
    return A.cadence_overdue(t.archived, t.fulls, newest_moment(t), rotate_s=14400)


def latest_per_key(t: Tables) -> DataFrame:
    return R.latest_per_key(t.change_log, ["lineage", "key"], ["seq", "pos"], ["op", "image"])


def live_table(t: Tables) -> DataFrame:
    """The keyed table after the whole change stream went through the streaming path."""
    folder = new_path(t.spark, "live")
    table = LiveTable(t.spark, folder, ["lineage", "key"], ["seq", "pos"], ["image"], buckets=16)
    table.start(t.change_stream, f"{folder}/progress").awaitTermination()
    return table.read()


def apply_conflicts(t: Tables) -> DataFrame:
    return R.apply_conflicts(t.snapshot, t.change_log, ["lineage", "key"], ["seq", "pos"])


def recovery_bound(t: Tables) -> DataFrame:
    points = t.segments.select(
        "lineage",
        "seq",
        F.col("last_ts").alias("target"),
        (F.col("first_ts") + F.expr("interval 3 hours")).alias("achieved"),
        (F.col("seq") * 60).alias("rotate_s"),
    )
    return A.recovery_bound(points).select("lineage", "seq", "lag_s", "bound_s", "within")


def _readiness(t: Tables) -> DataFrame:
    return recovery.restore_readiness(t.targets, t.fulls, t.archived, rotate_s=7200)


def restore_readiness(t: Tables) -> DataFrame:
    return _readiness(t).select(
        "request_id", "dump_key", "run_length", "gap_after", "gap_next", "achieved", "lag_s", "verdict"
    )


def point_in_time_table(t: Tables) -> DataFrame:
    """The table at the instant of every approved request."""
    approved = _readiness(t).where(F.col("verdict") == "OK")
    fields = ["request_id", "archive_id", "lineage", "dump_key", "start_seq", "start_pos", "target", "verdict"]
    return recovery.point_in_time_table(t.snapshot, t.change_log_late, written(approved.select(*fields)))


def point_in_time_orders(t: Tables) -> DataFrame:
    """Customer balances replayed through the order log up to 1998-06-15."""
    orders = t.read("orders").where(F.col("o_orderdate") < F.lit("1998-06-15").cast("timestamp_ntz"))
    changes = orders.select(
        F.col("o_custkey").alias("key"),
        F.unix_date(F.to_date("o_orderdate")).alias("seq"),
        F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert").alias("op"),
        F.col("o_totalprice").alias("image"),
    )
    base = t.read("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("image"))
    return R.fold(base, changes, ["key"], ["seq", "pos"], ["image"])


def scalar_functions(t: Tables) -> DataFrame:
    """The text and time functions over every object key, backup and host."""
    name = X.basename(F.col("key"))
    return t.objects.select(
        "archive_id",
        "key",
        name.alias("base"),
        X.log_seq(name).alias("seq"),
        X.trim_slashes(F.concat(F.lit("//"), "key", F.lit("/"))).alias("trimmed"),
        X.host_label(F.concat(F.lit(" "), name, F.lit(":3306"))).alias("label"),
        X.is_uuid(F.col("key")).alias("is_uuid"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        archive_listing, full_backup_scan, full_backup_rejects, segment_index_scan, event_header_scan,
        dump_coordinate_scan, closed_segments, start_coordinate_filter, newest_full_asof, fallback_fulls,
        pending_uploads, lost_segments, upload_reconcile, segment_order, replay_plan, purge_cut,
        ledger_after_purge, stop_cut, segment_coverage, needs_full_backup, cadence_overdue, latest_per_key, live_table,
        apply_conflicts, recovery_bound, restore_readiness, point_in_time_table, point_in_time_orders,
        scalar_functions,
    )
}
