"""The views of ``plans.tables`` in SQL, as common table expressions."""

VIEWS = {
    "change_log": """
        SELECT 'a' || (user_id % 4) AS archive_id, 'n' || (user_id % 8) AS lineage,
               event_id // 250 + 1 AS seq, event_id % 250 AS pos, ts, user_id AS key,
               CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'upsert' END AS op,
               value AS image
        FROM events""",
    "change_log_late": """
        SELECT archive_id, lineage, seq, pos,
               CASE WHEN (seq * 250 + pos) % 40 = 7 THEN ts + INTERVAL 20 HOUR ELSE ts END AS ts, key, op, image
        FROM change_log""",
    "segments": """
        SELECT *, 'binlog.' || lpad(CAST(seq AS VARCHAR), 6, '0') AS name,
               CASE WHEN (archive_id = 'a2' AND first_ts >= TIMESTAMP '2024-01-07' AND first_ts < TIMESTAMP '2024-01-10')
                      OR (archive_id = 'a1' AND first_ts >= TIMESTAMP '2024-01-22' AND first_ts < TIMESTAMP '2024-01-25')
                    THEN 'lost'
                    WHEN archive_id = 'a3' AND first_ts >= TIMESTAMP '2024-01-20' THEN 'pending'
                    ELSE 'uploaded' END AS status
        FROM (SELECT archive_id, lineage, seq, arg_min(ts, pos) AS first_ts, arg_max(ts, pos) AS last_ts,
                     min(pos) AS first_pos
              FROM change_log GROUP BY archive_id, lineage, seq)""",
    "archived": "SELECT * FROM segments WHERE status = 'uploaded'",
    "active": "SELECT lineage, max(seq) AS active_seq FROM segments GROUP BY lineage",
    "ledger": """
        SELECT lineage, name, status, seq FROM segments
        WHERE status = 'uploaded' OR (status = 'lost' AND seq % 2 = 0)""",
    "disk": "SELECT lineage, seq, name FROM segments WHERE status <> 'lost'",
    "fulls": """
        SELECT archive_id, lineage,
               'binlog/server-' || lineage || '/full/' || strftime(date_trunc('hour', ts), '%Y%m%d%H') || '.sql.gz' AS dump_key,
               date_trunc('hour', ts) AS taken_at,
               'binlog.' || lpad(CAST(seq AS VARCHAR), 6, '0') AS start_file, seq AS start_seq, pos AS start_pos
        FROM (SELECT *, row_number() OVER (PARTITION BY lineage, CAST(ts AS DATE) ORDER BY seq, pos) AS rn FROM change_log)
        WHERE rn = 1""",
    "targets": """
        SELECT DISTINCT archive_id, archive_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS request_id,
               CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 12 HOUR + INTERVAL 500 MILLISECOND AS target
        FROM change_log""",
    "objects": """
        SELECT archive_id, unnest([dump_key, replace(dump_key, '.sql.gz', '.meta.json')]) AS key FROM fulls
        UNION ALL SELECT archive_id, 'binlog/server-' || lineage || '/binlog/' || name FROM archived
        UNION ALL SELECT archive_id, unnest(['binlog/server-/full/' || name,
                                             'binlog2/server-' || lineage || '/binlog/' || name,
                                             'x/' || name]) FROM segments WHERE status = 'lost'""",
    "member_views": """
        SELECT cluster, round, observer, member_id, CASE WHEN e.value >= 1 THEN 'host-' || member_id END AS host,
               CASE e.event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'RECOVERING'
                    WHEN 'click' THEN 'UNREACHABLE' ELSE 'ONLINE' END AS state,
               CASE WHEN e.event_id % 3 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role
        FROM (SELECT user_id // 5 AS cluster, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 7 AS round,
                     'm' || (user_id % 5) AS observer, 'm' || (event_id % 5) AS member_id,
                     arg_max({event_id: event_id, event_type: event_type, value: value}, event_id) AS e
              FROM events GROUP BY ALL)""",
    "reports": """
        SELECT cluster, round, 'm' || seed_rank AS node, seed_rank, state,
               CASE WHEN e.event_id % 3 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role,
               state IN ('ONLINE', 'RECOVERING') AND round % 3 = 0 AS group_active,
               CASE WHEN e.value < 1 THEN NULL WHEN e.value BETWEEN 3 AND 8 THEN ' '
                    WHEN e.event_id % 61 = 7 THEN source || ':' || (progress + 3) || '-' || progress
                    WHEN e.event_id % 61 = 17 THEN source || ':1-' || progress || '-9'
                    WHEN e.event_id % 61 = 27 THEN source || ':0-' || progress
                    WHEN e.event_id % 61 = 37 THEN ':1-' || progress
                    ELSE source || ':1-' || progress || CASE WHEN e.value > 100 THEN E',\n m' || seed_rank || ':1' ELSE '' END
                    END AS txn_set,
               e.value >= 1 AND e.value NOT BETWEEN 3 AND 8 AND e.event_id % 61 IN (7, 17, 27, 37) AS malformed,
               CASE WHEN e.value < 1 OR e.value BETWEEN 3 AND 8 THEN 0 ELSE progress END AS upto, e.value > 100 AS errant,
               e.event_id % 4 = 0 AS prelog, progress % 3 AS generation,
               CASE WHEN e.value >= 2 THEN CASE WHEN seed_rank % 2 = 0 THEN 'U' ELSE 'u' END || cluster || '-' || (seed_rank % 3) END AS uuid,
               CASE WHEN e.event_id % 5 <> 0 THEN 'g' || (e.event_id % 2) END AS group_name,
               e.event_id % 7 = 0 AS pinned, e.event_id % 3 = 1 AS fresh, e.event_id % 10 <> 0 AS checked
        FROM (SELECT *, (round - 19723) * 4 + hour(e.ts) // 6 + 1 AS progress,
                     CASE WHEN seed_rank % 2 = 0 THEN 'C' ELSE 'c' END || cluster AS source,
                     CASE e.event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'RECOVERING'
                          WHEN 'click' THEN 'UNREACHABLE' ELSE 'ONLINE' END AS state
              FROM (SELECT user_id // 5 AS cluster, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS round,
                           user_id % 5 AS seed_rank,
                           arg_max({event_id: event_id, event_type: event_type, value: value, ts: ts}, event_id) AS e
                    FROM events GROUP BY ALL))""",
    "answers": """
        SELECT p.cluster, p.round, p.observer, p.peer, p.seed_rank, p.answer,
               CASE WHEN answer = 'state' THEN r.group_active END AS group_active,
               CASE WHEN answer = 'state' THEN r.role END AS role,
               CASE WHEN answer = 'state' THEN CASE WHEN p.early THEN regexp_replace(r.txn_set, ',\\s*m\\d:1', '') ELSE r.txn_set END END AS txn_set,
               CASE WHEN answer = 'state' THEN r.upto END AS upto,
               CASE WHEN answer = 'state' THEN r.errant END AS errant,
               answer = 'state' AND coalesce(r.malformed, false) AS malformed,
               CASE WHEN answer = 'state' THEN r.prelog END AS prelog,
               CASE WHEN answer = 'state' THEN r.generation END AS generation,
               CASE WHEN answer = 'state' THEN r.uuid END AS uuid,
               CASE WHEN answer = 'state' THEN r.group_name END AS group_name
        FROM (SELECT h.*, CASE WHEN h.heard <> 'state' THEN h.heard WHEN r.node IS NULL THEN 'unreachable'
                               WHEN NOT r.checked THEN 'not_ready' ELSE 'state' END AS answer
              FROM (SELECT cluster, round, observer, 'm' || seed_rank AS peer, seed_rank,
                           e.event_id % 6 = 0 AS early,
                           CASE WHEN e.event_type = 'click' THEN 'unreachable'
                                WHEN e.event_type = 'error' AND e.event_id % 2 = 0 THEN 'not_ready' ELSE 'state' END AS heard
                    FROM (SELECT user_id // 5 AS cluster, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS round,
                                 'm' || (user_id % 5) AS observer, (user_id % 5 + 1 + event_id % 4) % 5 AS seed_rank,
                                 arg_max({event_id: event_id, event_type: event_type}, event_id) AS e
                          FROM events GROUP BY ALL)) h
              LEFT JOIN reports r ON r.cluster = h.cluster AND r.round = h.round AND r.node = h.peer) p
        LEFT JOIN reports r ON r.cluster = p.cluster AND r.round = p.round AND r.node = p.peer""",
    "relations": """
        SELECT a.cluster, a.round, a.observer, a.peer, a.seed_rank, a.group_active, a.prelog,
               coalesce(a.generation, 0) AS generation, r.seed_rank AS my_rank, r.prelog AS my_prelog,
               r.generation AS my_generation,
               CASE WHEN a.txn_set IS NULL OR r.txn_set IS NULL OR a.malformed OR r.malformed THEN 'Unknown'
                    WHEN a.upto <= mine AND NOT peer_errant THEN CASE WHEN mine <= a.upto AND NOT my_errant THEN 'Equal' ELSE 'Behind' END
                    WHEN mine <= a.upto AND NOT my_errant THEN 'Ahead' ELSE 'Diverged' END AS relation
        FROM (SELECT *, errant AND txn_set LIKE '%m%' AS peer_errant FROM answers) a
        JOIN (SELECT *, upto AS mine, coalesce(errant AND txn_set LIKE '%m%', false) AS my_errant FROM reports) r
          ON r.cluster = a.cluster AND r.round = a.round AND r.node = a.observer""",
    "declared": "SELECT DISTINCT cluster, observer, peer, seed_rank FROM answers",
    "waived": """
        SELECT cluster, round, observer, peer FROM (
            SELECT *, min(round) FILTER (WHERE answer = 'unreachable') OVER (PARTITION BY cluster, observer, peer, stretch) AS since
            FROM (SELECT *, sum(CASE WHEN answer = 'unreachable' THEN 0 ELSE 1 END)
                                OVER (PARTITION BY cluster, observer, peer ORDER BY round) AS stretch FROM answers))
        WHERE answer = 'unreachable' AND round - since >= 1""",
    "settled": """
        SELECT *, CASE WHEN relation = 'Diverged' THEN
                       CASE WHEN generation <> my_generation THEN generation > my_generation ELSE seed_rank < my_rank END
                  END AS peer_wins
        FROM relations""",
    "writable": """
        SELECT cluster, round, observer,
               count(*) FILTER (WHERE state <> 'UNREACHABLE') * 2 > count(*)
               AND bool_or(member_id = observer AND state = 'ONLINE' AND role = 'PRIMARY') AS writable
        FROM member_views GROUP BY cluster, round, observer""",
    "txn_rows": """
        SELECT unnest(['all', 'copy']) AS owner, l_returnflag AS source, l_orderkey AS lo, l_orderkey + l_linenumber % 2 AS hi FROM lineitem
        UNION ALL SELECT 'bulk', l_returnflag, l_orderkey, l_orderkey + l_linenumber % 2 FROM lineitem WHERE l_quantity > 5
        UNION ALL SELECT 'paid', l_returnflag, l_orderkey, l_orderkey + l_linenumber % 2 FROM lineitem WHERE l_discount > 0.01
        UNION ALL SELECT 'both', l_returnflag, l_orderkey, l_orderkey + l_linenumber % 2 FROM lineitem
                  WHERE l_quantity > 5 AND l_discount > 0.01""",
    "points": "SELECT DISTINCT owner, source, unnest(range(lo, hi + 1)) AS n FROM txn_rows",
    "islands": """
        SELECT owner, source, min(n) AS lo, max(n) AS hi FROM (
            SELECT *, n - row_number() OVER (PARTITION BY owner, source ORDER BY n) AS island FROM points)
        GROUP BY owner, source, island""",
    "pairs": """
        SELECT a, b FROM (SELECT unnest(['all', 'both', 'bulk', 'copy', 'none', 'paid']) AS a)
        JOIN (SELECT unnest(['all', 'both', 'bulk', 'copy', 'none', 'paid']) AS b) ON a < b""",
    "missing": """
        SELECT p.a, p.b, m.source, m.n FROM pairs p JOIN points m ON m.owner = p.a
        LEFT JOIN points o ON o.owner = p.b AND o.source = m.source AND o.n = m.n WHERE o.n IS NULL""",
    "surplus": """
        SELECT p.a, p.b, m.source, m.n FROM pairs p JOIN points m ON m.owner = p.b
        LEFT JOIN points o ON o.owner = p.a AND o.source = m.source AND o.n = m.n WHERE o.n IS NULL""",
    "node_configs": """
        SELECT s_suppkey AS node, 'host-' || s_suppkey AS self, s_acctbal > 8000 AS unlisted FROM supplier""",
    "polls": """
        SELECT user_id AS node, epoch_us(ts) AS at_us, event_id, ts,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'RECOVERING' WHEN 'click' THEN 'OFFLINE'
                    ELSE 'ONLINE' END AS state,
               CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS signature,
               CASE WHEN event_id % 3 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role,
               CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'view' THEN 'planned_stop' ELSE 'start' END AS event,
               event_type = 'error' AS gone, event_type IN ('view', 'purchase', 'signup') AS passed, value,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
        FROM events""",
    "telemetry": """
        SELECT event_id, ts, user_id, value, event_type, 'm' || user_id AS node, props,
               CASE WHEN event_id % 2 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role,
               CASE WHEN event_id % 3 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS new_role,
               CASE event_type WHEN 'signup' THEN 'fleet.node_started' WHEN 'click' THEN 'fleet.role_changed'
                    WHEN 'error' THEN 'fleet.process_died' WHEN 'purchase' THEN 'fleet.no_primary'
                    ELSE 'fleet.component_error' END AS kind
        FROM events""",
    "snapshot": """
        SELECT 'n' || (c_custkey % 8) AS lineage, c_custkey AS key, c_acctbal AS image FROM customer""",
}

NEEDS = {
    "change_log": [],
    "change_log_late": ["change_log"],
    "segments": ["change_log"],
    "archived": ["segments"],
    "active": ["segments"],
    "ledger": ["segments"],
    "disk": ["segments"],
    "fulls": ["change_log"],
    "targets": ["change_log"],
    "objects": ["fulls", "archived"],
    "polls": [],
    "telemetry": [],
    "snapshot": [],
    "member_views": [],
    "reports": [],
    "answers": ["reports"],
    "relations": ["answers"],
    "declared": ["answers"],
    "waived": ["answers"],
    "settled": ["relations"],
    "writable": ["member_views"],
    "txn_rows": [],
    "points": ["txn_rows"],
    "islands": ["points"],
    "pairs": [],
    "missing": ["points", "pairs"],
    "surplus": ["points", "pairs"],
    "node_configs": [],
}


def with_views(names: list[str], query: str) -> str:
    """``query`` preceded by the named views and those they need, in order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    joiner = ",\n" if query.lstrip().upper().startswith("WITH ") else "\n"
    body = query.lstrip()[5:] if joiner == ",\n" else query
    return f"WITH {views}{joiner}{body}" if wanted else query
