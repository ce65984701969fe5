"""Reference SQL for the temporal and telemetry queries."""

from tidemark.plans.membership_oracle import ORACLE as _MEMBERSHIP
from tidemark.plans.oracle_views import with_views

_STREAK = """
    epochs AS (
        SELECT *, sum(CASE WHEN event = 'ready' THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY rn) AS epoch,
               CASE event WHEN 'start' THEN 1 WHEN 'planned_stop' THEN -1 ELSE 0 END AS step FROM polls),
    walks AS (SELECT *, sum(step) OVER (PARTITION BY node, epoch ORDER BY rn) AS walk FROM epochs),
    streaks AS (
        SELECT *, CAST(walk - least(0, min(walk) OVER (PARTITION BY node, epoch ORDER BY rn)) AS BIGINT) AS streak FROM walks)"""

_GATE = """
    CASE WHEN n >= {cap} THEN 'CAP'
         WHEN n > 0 AND at_us // 1000000 < last_us // 1000000 + {base} * (1 << CAST(least(n - 1, 16) AS INTEGER)) THEN 'BACKOFF' ELSE 'GO' END"""

# A stretch is named by the number of rows before it on which the condition failed.
_STRETCH = """
    stretches AS (
        SELECT *, sum(CASE WHEN {on} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY {order}) AS stretch FROM {source}),
    since AS (
        SELECT *, min({order}) FILTER (WHERE {on}) OVER (PARTITION BY {keys}, stretch) AS since FROM stretches WHERE {on})"""

ORACLE = {
    "continuous_dwell": with_views(
        ["polls"],
        f"""WITH {_STRETCH.format(on="gone", keys="node", order="at_us", source="polls")}
        SELECT node, at_us, event_id, since, at_us - since >= 21600000000 AS fired FROM since""",
    ),
    "stable_verdict": f"""
        WITH verdicts AS ({_MEMBERSHIP["bootstrap_verdict"]}),
        {_STRETCH.format(on="verdict = 'SAFE'", keys="cluster, observer", order="round", source="verdicts")}
        SELECT cluster, observer, round, since, round - since >= 2 AS fired FROM since""",
    "stuck_member": with_views(
        ["polls"],
        """
        WITH marked AS (
            SELECT *, max(CASE WHEN state = 'ONLINE' THEN rn END) OVER before AS online_rn,
                   max(CASE WHEN state = 'RECOVERING' THEN rn END) OVER before AS recovering_rn,
                   lag(state) OVER (PARTITION BY node ORDER BY rn) AS was
            FROM polls WINDOW before AS (PARTITION BY node ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        known AS (
            SELECT m.*, CASE WHEN m.recovering_rn > coalesce(m.online_rn, 0) THEN p.signature ELSE '' END AS last_sig
            FROM marked m LEFT JOIN polls p ON p.node = m.node AND p.rn = m.recovering_rn),
        clocks AS (
            SELECT *, last_value(CASE WHEN state IN ('ERROR', 'RECOVERING') AND (
                          coalesce(was, '') NOT IN ('ERROR', 'RECOVERING') OR (state = 'RECOVERING' AND signature <> last_sig))
                      THEN at_us END IGNORE NULLS) OVER (PARTITION BY node ORDER BY rn ROWS UNBOUNDED PRECEDING) AS since
            FROM known)
        SELECT node, at_us, event_id, state, since, at_us - since >= 21600000000 AS fired FROM clocks
        WHERE state IN ('ERROR', 'RECOVERING')""",
    ),
    "failure_streak": with_views(
        ["polls"],
        f"""WITH {_STREAK}
        SELECT node, at_us, event_id, event, streak, event = 'start' AND streak >= 3 AS alert FROM streaks""",
    ),
    "heal_gate": with_views(
        ["polls"],
        f"""
        WITH attempts AS (
            SELECT *, row_number() OVER (PARTITION BY node ORDER BY at_us, event_id) - 1 AS n,
                   lag(at_us) OVER (PARTITION BY node ORDER BY at_us, event_id) AS last_us FROM polls WHERE gone)
        SELECT node, event_id, n AS attempts_before, {_GATE.format(cap=8, base=10800)} AS verdict FROM attempts""",
    ),
    "heal_budget": with_views(
        ["polls"],
        f"""WITH {_STRETCH.format(on="state = 'ONLINE'", keys="node", order="at_us", source="polls")},
        resets AS (SELECT node, at_us FROM since WHERE at_us - since >= 28800000000),
        attempts AS (
            SELECT a.node, a.event_id, a.at_us, count(e.rn) AS n, max(e.at_us) AS last_us
            FROM (SELECT p.*, (SELECT max(r.at_us) FROM resets r WHERE r.node = p.node AND r.at_us < p.at_us) AS reset_us
                  FROM polls p WHERE gone) a
            LEFT JOIN polls e ON e.node = a.node AND e.gone AND e.rn < a.rn AND e.at_us > coalesce(a.reset_us, 0)
            GROUP BY a.node, a.event_id, a.at_us)
        SELECT node, event_id, n AS attempts_before, {_GATE.format(cap=4, base=21600)} AS verdict FROM attempts""",
    ),
    "edge_alert": with_views(
        ["polls"],
        """
        SELECT node, at_us, event_id, CASE WHEN value > 50 THEN 'edge, ' ELSE '' END || 'primary-' || node AS backends FROM (
            SELECT *, lag(passed) OVER (PARTITION BY node ORDER BY rn) AS was FROM polls WHERE NOT gone)
        WHERE NOT passed AND coalesce(was, true)""",
    ),
    "fall_rise": with_views(
        ["polls"],
        """
        WITH pairs AS (SELECT *, lag(passed) OVER (PARTITION BY node ORDER BY rn) AS was FROM polls)
        SELECT node, at_us, event_id, passed,
               last_value(CASE WHEN passed = was THEN passed END IGNORE NULLS)
                   OVER (PARTITION BY node ORDER BY rn ROWS UNBOUNDED PRECEDING) AS up FROM pairs""",
    ),
    "incident_dedupe": with_views(
        ["polls"],
        "SELECT node, at_us AS start_us, event_id FROM polls WHERE rn = 1 OR CAST(trunc(value * 1000000) AS BIGINT) >= 60000000",
    ),
    "transitions": with_views(
        ["polls"],
        """
        SELECT node, at_us, event_id, state FROM (
            SELECT *, lag(state) OVER (PARTITION BY node ORDER BY rn) AS was FROM polls) WHERE state IS DISTINCT FROM was""",
    ),
    "role_changes": with_views(
        ["polls"],
        """
        SELECT node, at_us, event_id, was AS old_role, role AS new_role FROM (
            SELECT *, lag(role) OVER (PARTITION BY node ORDER BY rn) AS was FROM polls) WHERE role <> was""",
    ),
    "delivery_outcome": """
        SELECT date_trunc('hour', ts) AS hour,
               CASE WHEN value < 15 THEN 'rejected: http status' WHEN event_type = 'error' THEN 'rejected: graphql errors'
                    ELSE 'sent' END AS outcome, count(*) AS n
        FROM events GROUP BY ALL""",
    "event_envelope": with_views(
        ["telemetry"],
        """
        SELECT event_id, kind,
               CASE event_type
                   WHEN 'signup' THEN 'node ' || node || ' is up in the role ' || role
                   WHEN 'click' THEN 'node ' || node || ' went from role ' || role || ' to role ' || new_role
                   WHEN 'error' THEN 'on ' || node || ' the process server ended, exit code '
                       || CASE WHEN value >= 10 THEN CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) ELSE 'unknown' END
                   WHEN 'purchase' THEN 'none of these backends is a healthy primary: ' || CASE WHEN value > 90 THEN 'edge, ' ELSE '' END || node || '.'
                   ELSE 'archiver could not finish step ' || (event_id % 4) || ' (' || props || ')' END AS message,
               CASE event_type
                   WHEN 'signup' THEN '{"type":"NodeStarted","node":"' || node || '","role":"' || role || '"}'
                   WHEN 'click' THEN '{"type":"RoleChanged","node":"' || node || '","old_role":"' || role || '","new_role":"' || new_role || '"}'
                   WHEN 'error' THEN '{"type":"ProcessDied","node":"' || node || '","process":"server","exit_code":'
                       || CASE WHEN value >= 10 THEN CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) ELSE 'null' END || '}'
                   WHEN 'purchase' THEN '{"type":"NoPrimary","backends":[' || CASE WHEN value > 90 THEN '"edge",' ELSE '' END || '"' || node || '"]}'
                   ELSE '{"type":"ComponentError","component":"archiver","error":"' || replace(props, '"', '\\"')
                       || '","context":"step ' || (event_id % 4) || '"}' END AS payload
        FROM telemetry""",
    ),
    "events_by_kind": with_views(
        ["telemetry"], "SELECT date_trunc('day', ts) AS window_start, kind, count(*) AS n FROM telemetry GROUP BY ALL"
    ),
    "run_marker_status": """
        SELECT volume, marker, marker IN ('in_progress', 'unparseable') AS crashed FROM (
            SELECT o_orderkey AS volume,
                   CASE WHEN o_totalprice < 120000 THEN 'unparseable'
                        WHEN o_orderstatus = 'O' THEN 'in_progress' ELSE 'completed' END AS marker FROM orders
            UNION ALL SELECT -o_orderkey - 1, 'absent' FROM orders)""",
    "edge_stats_scan": """
        SELECT (user_id // 5) || '@' || strftime(ts, '%Y%m%d%H') AS poll,
               CASE WHEN event_type = 'click' THEN 'reads' ELSE 'primary_backend' END AS proxy,
               CASE WHEN event_type = 'view' THEN 'BACKEND' ELSE 'server-' || user_id END AS server,
               CASE WHEN value > 80 THEN 'UP 1/2' WHEN value > 30 THEN 'DOWN' ELSE 'UP' END AS status, count(*) AS n
        FROM events WHERE value >= 5 GROUP BY ALL""",
    "backend_up_any": """
        SELECT (user_id // 5) || '@' || strftime(ts, '%Y%m%d%H') AS poll,
               bool_or(event_type NOT IN ('click', 'view') AND value <= 30) AS up
        FROM events WHERE value >= 5 GROUP BY ALL""",
    "log_signal_scan": with_views(
        ["segments"],
        """
        SELECT s.lineage, 'log lost from disk before upload: ' || s.name AS message, s.name AS file
        FROM segments s WHERE s.status = 'lost'""",
    ),
    "state_sink": with_views(["ledger"], "SELECT lineage, name, status FROM ledger"),
    "heal_ledger_scan": """
        SELECT event_id,
               CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 2147483647 ELSE event_id % 7 END AS INTEGER) AS attempts,
               CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN NULL ELSE user_id END AS last_unix,
               CASE event_type WHEN 'click' THEN 0 ELSE user_id END AS counter FROM events""",
    "rfc3339_times": """
        SELECT event_id,
               CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d') WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')
                    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS raw,
               CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN date_trunc('second', ts) - INTERVAL 2 HOUR
                    ELSE date_trunc('millisecond', ts) END AS instant FROM events""",
}
