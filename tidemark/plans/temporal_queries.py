"""Registered queries on conditions over time and on telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import membership as M
from tidemark.operators import telemetry as E
from tidemark.operators import temporal as T
from tidemark.plans.tables import Tables, text
from tidemark.session import new_path, written
from tidemark.sources import logs as S
from tidemark.sources.versioned import VersionedTable

HOUR_S = 3600


def continuous_dwell(t: Tables) -> DataFrame:
    return T.continuous_dwell(t.polls, 6 * HOUR_S)


def stable_verdict(t: Tables) -> DataFrame:
    answers, reports, declared = t.stored_polls(*M.JUDGED)
    return T.stable_verdict(written(M.bootstrap_verdict(answers, reports, declared, M.waived_peers(answers, 1))), 2)


def stuck_member(t: Tables) -> DataFrame:
    return T.stuck_member(t.polls, 6 * HOUR_S)


def failure_streak(t: Tables) -> DataFrame:
    return T.failure_streak(t.polls)


def heal_gate(t: Tables) -> DataFrame:
    return T.heal_gate(t.polls.where("attempt"), cap=8, base_s=3 * HOUR_S)


def heal_budget(t: Tables) -> DataFrame:
    return T.heal_budget(t.polls, cap=4, base_s=6 * HOUR_S, reset_s=8 * HOUR_S)


def edge_alert(t: Tables) -> DataFrame:
    """Alerts with the backends that their poll found down."""
    asked = F.filter(F.array(F.when(F.col("value") > 50, "edge"), text("primary-", F.col("node"))), lambda b: b.isNotNull())
    alerts = T.edge_alert(t.polls.withColumn("backends", asked))
    return alerts.withColumn("backends", F.array_join("backends", ", "))


def fall_rise(t: Tables) -> DataFrame:
    return T.fall_rise(t.polls)


def incident_dedupe(t: Tables) -> DataFrame:
    ended = F.col("at_us") + (F.col("value") * T.MICROS).cast("bigint")
    return T.incident_dedupe(t.polls.select("node", F.col("at_us").alias("start_us"), ended.alias("end_us"), "event_id"))


def transitions(t: Tables) -> DataFrame:
    return T.transitions(t.polls, "state", ["node"], ["at_us", "event_id"])


def role_changes(t: Tables) -> DataFrame:
    return T.role_changes(t.polls, ["node"], ["at_us", "event_id"])


def delivery_outcome(t: Tables) -> DataFrame:
    return E.delivery_rollup(t.deliveries)


def event_envelope(t: Tables) -> DataFrame:
    return E.event_envelope(t.telemetry).drop("ts")


def events_by_kind(t: Tables) -> DataFrame:
    return E.events_by_kind(t.telemetry)


def run_marker_status(t: Tables) -> DataFrame:
    return E.run_marker_status(t.volumes, t.markers)


def edge_stats_scan(t: Tables) -> DataFrame:
    rows = S.edge_stats_scan(t.edge_lines)
    return rows.groupBy("poll", "proxy", "server", "status").agg(F.count(F.lit(1)).alias("n"))


def backend_up_any(t: Tables) -> DataFrame:
    return E.backend_up_any(S.edge_stats_scan(t.edge_lines), "primary_backend")


def log_signal_scan(t: Tables) -> DataFrame:
    """Loss reports of files the archive itself counts as lost, each in its own lineage."""
    files = t.segments.where(F.col("status") == "lost").select("lineage", F.col("name").alias("file"))
    return S.log_signal_scan(t.log_lines, files, "lost from disk", on=["lineage", "file"])


def state_sink(t: Tables) -> DataFrame:
    """The ledger written as a new version of a state table and read back."""
    table = VersionedTable(t.spark, new_path(t.spark, "ledger"))
    table.write(t.ledger)
    return table.read()


def heal_ledger_scan(t: Tables) -> DataFrame:
    """Ledger texts of every event's node; torn ones read as spent."""
    raw = (
        F.when(F.col("event_type") == "view", None)
        .when(F.col("event_type") == "error", text("x", F.col("user_id")))
        .otherwise(text(F.col("event_id") % 7, " ", F.col("user_id"), "\n"))
    )
    ledger = X.heal_ledger(raw)
    return t.events.select(
        "event_id",
        ledger.getField("attempts").alias("attempts"),
        ledger.getField("last_unix").alias("last_unix"),
        X.counter_or_zero(F.when(F.col("event_type") == "click", "x").otherwise(text(" ", F.col("user_id")))).alias("counter"),
    )


def rfc3339_times(t: Tables) -> DataFrame:
    """Instants written with an offset parse; bare dates do not."""
    written = F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd")).when(
        F.col("event_type") == "click", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    )
    raw = F.coalesce(written, X.format_rfc3339_millis(F.col("ts")))
    return t.events.select("event_id", raw.alias("raw"), X.parse_rfc3339(raw).alias("instant"))


QUERIES = {
    f.__name__: f
    for f in (
        continuous_dwell, stable_verdict, stuck_member, failure_streak, heal_gate, heal_budget, edge_alert,
        fall_rise, incident_dedupe, transitions, role_changes, delivery_outcome, event_envelope,
        events_by_kind, run_marker_status, edge_stats_scan, backend_up_any, log_signal_scan, state_sink,
        heal_ledger_scan, rfc3339_times,
    )
}
