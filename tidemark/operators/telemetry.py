"""Telemetry events, their delivery, edge backends and restore markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event types, and the kind each is reported as below a product's own prefix.
KINDS = {
    "NodeStarted": "node_started",
    "RoleChanged": "role_changed",
    "ProcessDied": "process_died",
    "NoPrimary": "no_primary",
    "ComponentError": "component_error",
}
FIELDS = {
    "NodeStarted": ["node", "role"],
    "RoleChanged": ["node", "old_role", "new_role"],
    "ProcessDied": ["node", "process", "exit_code"],
    "NoPrimary": ["backends"],
    "ComponentError": ["component", "error", "context"],
}


def _by_type(choice: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("type") == t, c) for t, c in choice.items()])


def event_kind(prefix: str) -> Column:
    return _by_type({t: F.lit(f"{prefix}.{k}") for t, k in KINDS.items()})


def event_message() -> Column:
    exit_code = F.coalesce(F.col("exit_code").cast("string"), F.lit("unknown"))
    return _by_type(
        {
            "NodeStarted": F.format_string("node %s is up in the role %s", "node", "role"),
            "RoleChanged": F.format_string("node %s went from role %s to role %s", "node", "old_role", "new_role"),
            "ProcessDied": F.format_string("on %s the process %s ended, exit code %s", F.col("node"), F.col("process"), exit_code),
            "NoPrimary": F.concat(
                F.lit("none of these backends is a healthy primary: "), F.concat_ws(", ", "backends"), F.lit(".")
            ),
            "ComponentError": F.format_string("%s could not finish %s (%s)", "component", "context", "error"),
        }
    )


def event_payload() -> Column:
    """The event as JSON, its type first, a missing exit code as null."""
    keep_nulls = {"ignoreNullFields": "false"}
    return _by_type({t: F.to_json(F.struct("type", *cols), keep_nulls) for t, cols in FIELDS.items()})


def event_envelope(events: DataFrame, prefix: str = "fleet") -> DataFrame:
    """Wide event rows to (other columns, kind, message, payload)."""
    payload_columns = {"type"} | {c for cols in FIELDS.values() for c in cols}
    keep = [c for c in events.columns if c not in payload_columns]
    return events.select(
        *keep, event_kind(prefix).alias("kind"), event_message().alias("message"), event_payload().alias("payload")
    )


def delivery_outcome(deliveries: DataFrame) -> DataFrame:
    """Adds ``outcome``: a bad status beats an error body, anything else was sent."""
    ok = F.col("status").between(200, 299)
    outcome = (
        F.when(~ok, "rejected: http status")
        .when(F.col("body").contains('"errors"'), "rejected: graphql errors")
        .otherwise("sent")
    )
    return deliveries.withColumn("outcome", outcome)


def delivery_rollup(deliveries: DataFrame) -> DataFrame:
    """Outcomes per hour of ``ts``."""
    return delivery_outcome(deliveries).groupBy(F.date_trunc("hour", "ts").alias("hour"), "outcome").agg(
        F.count(F.lit(1)).alias("n")
    )


def events_by_kind(events: DataFrame, every: str = "1 day", prefix: str = "fleet") -> DataFrame:
    """Events per kind and window of ``ts``."""
    return (
        events.groupBy(F.window("ts", every).alias("w"), event_kind(prefix).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "kind", "n")
    )


def backend_up_any(stats: DataFrame, proxy: str) -> DataFrame:
    """Per poll: is any server of ``proxy``, other than its summary row, exactly UP?"""
    up = (F.col("proxy") == proxy) & (F.col("server") != "BACKEND") & (F.col("status") == "UP")
    return stats.groupBy("poll").agg(F.bool_or(up).alias("up"))


def run_marker_status(volumes: DataFrame, markers: DataFrame) -> DataFrame:
    """volumes(volume) and markers(volume, marker_text) to the marker's state and ``crashed``.

    No marker means no restore was running; one that cannot be read counts as crashed.
    """
    marker = F.from_json("marker_text", "status STRING, target_time STRING, achieved_time STRING, updated_at STRING")
    complete = (
        F.col("m.status").isin("in_progress", "completed")
        & F.col("m.target_time").isNotNull()
        & F.col("m.updated_at").isNotNull()
    )
    state = (
        F.when(F.col("found").isNull(), "absent")
        .when(F.coalesce(complete, F.lit(False)), F.col("m.status"))
        .otherwise("unparseable")
    )
    return (
        volumes.select("volume")
        .join(markers.withColumns({"m": marker, "found": F.lit(True)}), "volume", "left")
        .select("volume", state.alias("marker"), state.isin("in_progress", "unparseable").alias("crashed"))
    )
