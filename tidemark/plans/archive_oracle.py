"""Reference SQL for the archive queries."""

from tidemark.plans.oracle_views import with_views

_CHOSEN = """
    chosen AS (
        SELECT t.archive_id, t.request_id, t.target, f.lineage, f.dump_key, f.taken_at, f.start_file,
               f.start_seq, f.start_pos
        FROM targets t LEFT JOIN (
            SELECT t.request_id, f.*, row_number() OVER (PARTITION BY t.request_id ORDER BY f.taken_at DESC, f.lineage DESC) AS pick
            FROM targets t JOIN fulls f ON f.archive_id = t.archive_id AND f.taken_at <= t.target
        ) f ON f.request_id = t.request_id AND f.pick = 1)"""

_PLANS = """
    starts AS (SELECT DISTINCT lineage, start_seq, start_file FROM {starts}),
    found AS (
        SELECT s.*, EXISTS (SELECT 1 FROM archived g WHERE g.lineage = s.lineage AND g.name = s.start_file) AS here
        FROM starts s),
    onward AS (
        SELECT s.lineage, s.start_seq, s.start_file, s.here, g.seq, g.name, g.last_ts,
               row_number() OVER (PARTITION BY s.lineage, s.start_file ORDER BY g.seq, g.name) AS rn
        FROM found s JOIN archived g ON g.lineage = s.lineage AND g.seq >= s.start_seq),
    breaks AS (
        SELECT lineage, start_file, min(rn) AS brk FROM onward WHERE here AND seq - start_seq + 1 <> rn
        GROUP BY lineage, start_file),
    plans AS (
        SELECT f.lineage, f.start_seq, f.start_file,
               CAST(count(o.rn) FILTER (WHERE f.here AND o.rn < coalesce(b.brk, o.rn + 1)) AS BIGINT) AS run_length,
               arg_max(o.name, o.rn) FILTER (WHERE f.here AND o.rn < coalesce(b.brk, o.rn + 1)) AS run_last,
               arg_max(o.last_ts, o.rn) FILTER (WHERE f.here AND o.rn < coalesce(b.brk, o.rn + 1)) AS run_last_ts,
               CASE WHEN f.here THEN CASE WHEN any_value(b.brk) IS NOT NULL
                        THEN arg_max(o.name, o.rn) FILTER (WHERE o.rn < b.brk) END
                    WHEN count(o.rn) > 0 THEN '' END AS gap_after,
               CASE WHEN f.here THEN max(o.name) FILTER (WHERE o.rn = b.brk)
                    ELSE arg_min(o.name, o.rn) END AS gap_next
        FROM found f LEFT JOIN onward o ON o.lineage = f.lineage AND o.start_file = f.start_file
        LEFT JOIN breaks b ON b.lineage = f.lineage AND b.start_file = f.start_file
        GROUP BY f.lineage, f.start_seq, f.start_file, f.here)"""

_READY = (
    _CHOSEN
    + ","
    + _PLANS.format(starts="chosen WHERE lineage IS NOT NULL")
    + """,
    reached AS (
        SELECT c.*, p.run_length, p.gap_after, p.gap_next,
               CASE WHEN p.gap_next IS NULL AND c.lineage IS NOT NULL THEN
                    CASE WHEN p.run_length = 0 THEN c.taken_at ELSE least(p.run_last_ts, c.target) END END AS achieved
        FROM chosen c LEFT JOIN plans p USING (lineage, start_seq, start_file)),
    ready AS (
        SELECT *, CAST(trunc((epoch_us(target) - epoch_us(achieved)) / 1000000) AS BIGINT) AS lag_s FROM reached),
    readiness AS (
        SELECT *, CASE WHEN lineage IS NULL THEN 'NO_FULL' WHEN gap_next IS NOT NULL THEN 'GAP'
                       WHEN lag_s <= 2 * 7200 + 60 THEN 'OK' ELSE 'SHORT' END AS verdict FROM ready)"""
)

_CUT = """
    cuts AS (
        SELECT lineage, CASE WHEN boundary > oldest THEN boundary END AS cut_seq FROM (
            SELECT d.lineage, min(d.seq) AS oldest,
                   min(d.seq) FILTER (WHERE d.seq = a.active_seq OR l.name IS NULL) AS boundary
            FROM disk d JOIN active a USING (lineage) LEFT JOIN ledger l ON l.lineage = d.lineage AND l.name = d.name
            GROUP BY d.lineage))"""

_REPLAY = """
    replay AS (
        SELECT c.request_id, c.target, g.* EXCLUDE (archive_id)
        FROM {log} g JOIN chosen c ON c.lineage = g.lineage
        WHERE g.seq > c.start_seq OR (g.seq = c.start_seq AND g.pos >= c.start_pos))"""

_NOW = "(SELECT max(ts) + INTERVAL 2 HOUR FROM change_log)"

ORACLE = {
    "archive_listing": with_views(
        ["objects"],
        """
        SELECT archive_id, key, split_part(split_part(key, '/', 2), 'server-', 2) AS lineage,
               split_part(key, '/', 3) AS kind, split_part(key, '/', 4) AS name,
               TRY_CAST(split_part(split_part(key, '/', 4), '.', -1) AS BIGINT) AS seq
        FROM objects WHERE key LIKE 'binlog/server-_%/%' AND key NOT LIKE 'binlog/server-/%'""",
    ),
    "full_backup_scan": with_views(
        ["fulls"],
        """
        SELECT archive_id, lineage, dump_key, taken_at, start_file, start_seq, start_pos, '8.0' AS version
        FROM fulls WHERE NOT (archive_id = 'a2' AND day(taken_at) % 2 = 0)""",
    ),
    "full_backup_rejects": with_views(
        ["fulls"],
        """
        SELECT archive_id, replace(dump_key, '.sql.gz', '.meta.json') AS key
        FROM fulls WHERE archive_id = 'a2' AND day(taken_at) % 2 = 0""",
    ),
    "segment_index_scan": with_views(["segments"], "SELECT lineage, name, seq FROM segments WHERE status <> 'lost'"),
    "event_header_scan": with_views(
        ["change_log"],
        """
        SELECT lineage, seq, pos, date_trunc('second', ts) AS ts FROM change_log
        WHERE op <> 'delete' AND image >= 1""",
    ),
    "dump_coordinate_scan": with_views(
        ["fulls"], "SELECT dump_key AS file, start_file, start_pos FROM fulls WHERE archive_id <> 'a2'"
    ),
    "closed_segments": with_views(
        ["segments", "active"],
        """
        SELECT lineage, seq, name, active_seq FROM segments JOIN active USING (lineage) WHERE seq < active_seq""",
    ),
    "start_coordinate_filter": with_views(
        ["fulls", "targets"],
        f"""WITH {_CHOSEN}, {_REPLAY.format(log="change_log")}
        SELECT request_id, count(*) AS n, min(seq * 250 + pos) AS first_at FROM replay GROUP BY request_id""",
    ),
    "newest_full_asof": with_views(["fulls", "targets"], f"WITH {_CHOSEN} SELECT * FROM chosen"),
    "fallback_fulls": with_views(
        ["fulls"],
        """
        SELECT archive_id, dump_key,
               row_number() OVER (PARTITION BY archive_id ORDER BY taken_at DESC, lineage, dump_key) AS rank,
               count(*) OVER (PARTITION BY archive_id) - 1 AS others,
               'server-' || lineage || ' full taken at ' || strftime(taken_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS line
        FROM fulls""",
    ),
    "pending_uploads": with_views(
        ["segments", "active", "ledger"],
        """
        SELECT s.lineage, s.seq, s.name FROM segments s JOIN active a USING (lineage)
        WHERE s.seq < a.active_seq AND s.status = 'pending'""",
    ),
    "lost_segments": with_views(
        ["segments", "active"],
        """
        SELECT s.lineage, s.seq, s.name FROM segments s JOIN active a USING (lineage)
        WHERE s.seq < a.active_seq AND s.status = 'lost' AND s.seq % 2 = 1""",
    ),
    "upload_reconcile": with_views(
        ["segments"],
        """
        SELECT lineage, name, lineage = 'n5' OR hour(first_ts) <> 3 AS keep FROM segments WHERE status = 'uploaded'""",
    ),
    "segment_order": with_views(
        ["segments"],
        """
        SELECT lineage, seq, name, row_number() OVER (PARTITION BY lineage ORDER BY seq, name) AS position FROM segments""",
    ),
    "replay_plan": with_views(
        ["archived", "fulls"], f"WITH {_PLANS.format(starts='fulls')} SELECT * FROM plans"
    ),
    "purge_cut": with_views(
        ["disk", "active", "ledger"],
        f"""WITH {_CUT}
        SELECT lineage, cut_seq, 'binlog.' || lpad(CAST(cut_seq AS VARCHAR), 6, '0') AS cut FROM cuts""",
    ),
    "ledger_after_purge": with_views(
        ["disk", "active", "ledger"],
        f"""WITH {_CUT}
        SELECT l.lineage, l.name, l.status FROM ledger l LEFT JOIN cuts c USING (lineage)
        WHERE NOT coalesce(l.status = 'uploaded' AND l.seq < c.cut_seq, false)""",
    ),
    "stop_cut": with_views(
        ["fulls", "targets", "change_log_late"],
        f"""WITH {_CHOSEN}, {_REPLAY.format(log="(SELECT '' AS archive_id, * EXCLUDE (archive_id) FROM change_log_late)")},
        marked AS (
            SELECT *, bool_or(ts >= date_trunc('second', target)) OVER (PARTITION BY request_id ORDER BY seq, pos) AS stopped
            FROM replay)
        SELECT request_id, count(*) AS n, max(seq * 250 + pos) AS last_at FROM marked WHERE NOT stopped
        GROUP BY request_id""",
    ),
    "segment_coverage": with_views(
        ["change_log_late"],
        "SELECT lineage, seq, arg_max(ts, pos) AS covered_to FROM change_log_late GROUP BY lineage, seq",
    ),
    "needs_full_backup": with_views(
        ["active", "fulls"],
        f"""
        SELECT a.lineage, max(f.taken_at) AS last_full, max(f.taken_at) + INTERVAL 1 DAY AS due_at,
               coalesce(max(f.taken_at) + INTERVAL 1 DAY <= {_NOW}, true) AS due
        FROM (SELECT lineage FROM active UNION ALL SELECT 'spare-' || lineage FROM active) a
        LEFT JOIN fulls f ON f.lineage = a.lineage GROUP BY a.lineage""",
    ),
    "cadence_overdue": with_views(
        ["archived", "fulls"],
        f"""
        WITH s AS (SELECT lineage, max(last_ts) AS last_segment FROM archived GROUP BY lineage),
             f AS (SELECT lineage, max(taken_at) AS last_full FROM fulls GROUP BY lineage)
        SELECT lineage, last_segment, last_full,
               coalesce(last_segment + INTERVAL 4 HOUR < {_NOW}, true) AS rotation_overdue,
               coalesce(last_full + INTERVAL 1 DAY < {_NOW}, true) AS full_overdue
        FROM s FULL JOIN f USING (lineage)""",
    ),
    "latest_per_key": with_views(
        ["change_log"],
        """
        SELECT lineage, key, op, image FROM (
            SELECT *, row_number() OVER (PARTITION BY lineage, key ORDER BY seq DESC, pos DESC) AS rn FROM change_log)
        WHERE rn = 1""",
    ),
    "live_table": with_views(
        ["change_log"],
        """
        SELECT lineage, key, image FROM (
            SELECT *, row_number() OVER (PARTITION BY lineage, key ORDER BY seq DESC, pos DESC) AS rn FROM change_log)
        WHERE rn = 1 AND op <> 'delete'""",
    ),
    "apply_conflicts": with_views(
        ["change_log", "snapshot"],
        """
        SELECT c.lineage, c.key, c.seq, c.pos FROM change_log c
        WHERE c.op = 'insert'
          AND EXISTS (SELECT 1 FROM snapshot s WHERE s.lineage = c.lineage AND s.key = c.key)
          AND NOT EXISTS (SELECT 1 FROM change_log e WHERE e.lineage = c.lineage AND e.key = c.key
                          AND (e.seq < c.seq OR (e.seq = c.seq AND e.pos < c.pos)))""",
    ),
    "recovery_bound": with_views(
        ["segments"],
        """
        WITH p AS (SELECT lineage, seq, seq * 120 + 60 AS bound_s,
                          CAST(trunc((epoch_us(last_ts) - epoch_us(first_ts + INTERVAL 3 HOUR)) / 1000000) AS BIGINT) AS lag_s
                   FROM segments)
        SELECT lineage, seq, lag_s, bound_s, lag_s <= bound_s AS within FROM p""",
    ),
    "restore_readiness": with_views(
        ["fulls", "targets", "archived"],
        f"""WITH {_READY}
        SELECT request_id, dump_key, run_length, gap_after, gap_next, achieved, lag_s, verdict FROM readiness""",
    ),
    "point_in_time_table": with_views(
        ["fulls", "targets", "archived", "change_log_late", "snapshot"],
        f"""WITH {_READY},
        newest AS (
            SELECT * FROM readiness WHERE verdict = 'OK'),
        replay AS (
            SELECT c.request_id, c.target, g.seq, g.pos, g.ts, g.key, g.op, g.image,
                   bool_or(g.ts >= date_trunc('second', c.target)) OVER (PARTITION BY c.request_id ORDER BY g.seq, g.pos) AS stopped
            FROM change_log_late g JOIN newest c ON c.lineage = g.lineage
            WHERE g.seq > c.start_seq OR (g.seq = c.start_seq AND g.pos >= c.start_pos)),
        everything AS (
            SELECT n.request_id, s.key, s.image, 'upsert' AS op, -1 AS seq, -1 AS pos
            FROM snapshot s JOIN newest n USING (lineage)
            UNION ALL SELECT request_id, key, image, op, seq, pos FROM replay WHERE NOT stopped)
        SELECT request_id, key, image FROM (
            SELECT *, row_number() OVER (PARTITION BY request_id, key ORDER BY seq DESC, pos DESC) AS rn FROM everything)
        WHERE rn = 1 AND op <> 'delete'""",
    ),
    "point_in_time_orders": """
        WITH everything AS (
            SELECT c_custkey AS key, c_acctbal AS image, 'upsert' AS op, DATE '0001-01-01' AS day, -1 AS pos FROM customer
            UNION ALL
            SELECT o_custkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'upsert' END,
                   CAST(o_orderdate AS DATE), o_orderkey
            FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-15')
        SELECT key, image FROM (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC, pos DESC) AS rn FROM everything)
        WHERE rn = 1 AND op <> 'delete'""",
    "scalar_functions": with_views(
        ["objects"],
        """
        SELECT archive_id, key, split_part(key, '/', -1) AS base,
               TRY_CAST(split_part(split_part(key, '/', -1), '.', -1) AS BIGINT) AS seq, key AS trimmed,
               split_part(key, '/', -1) AS label, false AS is_uuid FROM objects""",
    ),
}
