"""Reference SQL for the transaction-set and membership queries."""

from tidemark.plans.oracle_views import with_views

_FNV = """
    list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({name}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda acc, x: (xor(acc, x) * 16777619) & 4294967295)"""

_IDENTITY = """
    live AS (
        SELECT cluster, round, observer AS node, arg_min(group_name, seed_rank) AS live_name,
               arg_min(generation, seed_rank) AS live_generation
        FROM answers WHERE group_active AND group_name IS NOT NULL GROUP BY cluster, round, observer)"""

ORACLE = {
    "txn_parse": """
        WITH texts AS (SELECT *, l_linenumber = 7 OR l_orderkey = 0 AS malformed, lower(l_returnflag) AS flag, lower(l_linestatus) AS status
                       FROM lineitem WHERE l_tax <> 0),
        spans AS (
            SELECT l_suppkey, flag AS source, l_orderkey AS lo, l_orderkey + l_linenumber AS hi FROM texts
            UNION ALL SELECT l_suppkey, flag, l_orderkey + 20, l_orderkey + 20 FROM texts
            UNION ALL SELECT l_suppkey, status || ':tag', l_orderkey, l_orderkey FROM texts
            UNION ALL SELECT l_suppkey, status || ':old', l_orderkey + 7, l_orderkey + 9 FROM texts
            UNION ALL SELECT l_suppkey, CASE l_orderkey % 7 WHEN 5 THEN 'w' ELSE 'w:y' END, CASE l_orderkey % 7 WHEN 5 THEN 1 ELSE 2 END,
                             CASE l_orderkey % 7 WHEN 5 THEN 1 ELSE 2 END FROM texts WHERE l_linenumber = 7 AND l_orderkey % 7 IN (5, 6))
        SELECT l_suppkey, source, count(*) AS n, CAST(sum(lo) AS BIGINT) AS sum_lo, CAST(sum(hi) AS BIGINT) AS sum_hi
        FROM spans WHERE lo >= 1 GROUP BY l_suppkey, source
        UNION ALL SELECT l_suppkey, NULL, count(*), NULL, NULL FROM texts WHERE malformed GROUP BY l_suppkey""",
    "coalesce_intervals": with_views(["islands"], "SELECT owner, source, lo, hi FROM islands"),
    "interval_containment": with_views(
        ["islands", "pairs"],
        """
        SELECT p.a, p.b, i.source, i.lo, i.hi, count(o.n) = i.hi - i.lo + 1 AS contained
        FROM pairs p JOIN islands i ON i.owner = p.a
        JOIN points m ON m.owner = i.owner AND m.source = i.source AND m.n BETWEEN i.lo AND i.hi
        LEFT JOIN points o ON o.owner = p.b AND o.source = m.source AND o.n = m.n
        GROUP BY p.a, p.b, i.source, i.lo, i.hi""",
    ),
    "txn_relation": with_views(
        ["missing", "surplus"],
        """
        SELECT a, b, b_in_a, a_in_b,
               CASE WHEN b_in_a AND a_in_b THEN 'Equal' WHEN b_in_a THEN 'Behind' WHEN a_in_b THEN 'Ahead' ELSE 'Diverged' END AS relation
        FROM (SELECT a, b, NOT EXISTS (SELECT 1 FROM surplus s WHERE s.a = p.a AND s.b = p.b) AS b_in_a,
                     NOT EXISTS (SELECT 1 FROM missing m WHERE m.a = p.a AND m.b = p.b) AS a_in_b FROM pairs p)""",
    ),
    "txn_subtract": with_views(
        ["missing"],
        """
        SELECT a, b, source, min(n) AS lo, max(n) AS hi FROM (
            SELECT *, n - row_number() OVER (PARTITION BY a, b, source ORDER BY n) AS island FROM missing)
        GROUP BY a, b, source, island""",
    ),
    "member_view_scan": with_views(["member_views"], "SELECT * REPLACE (coalesce(host, '') AS host) FROM member_views"),
    "active_members": with_views(
        ["member_views"],
        """
        SELECT cluster, round, observer, count(*) AS n_active FROM member_views
        WHERE state IN ('ONLINE', 'RECOVERING') GROUP BY cluster, round, observer""",
    ),
    "peer_list": with_views(
        ["node_configs"],
        """
        SELECT node, 'host-' || (node + 1) AS host, 0 AS seed_rank FROM node_configs
        UNION ALL SELECT node, 'host-' || (node + 2), CASE WHEN unlisted THEN 1 ELSE 2 END FROM node_configs""",
    ),
    "seed_rank": with_views(
        ["node_configs"], "SELECT node, CASE WHEN unlisted THEN 2147483647 ELSE 1 END AS seed_rank FROM node_configs"
    ),
    "name_verdict": """
        SELECT event_id, event_id % 5 + 1 AS rcode,
               CASE WHEN event_id % 5 = 2 AND value >= 1 AND value <= 150 AND event_type <> 'view' THEN 'gone'
                    ELSE 'exists_or_unknown' END AS verdict FROM events""",
    "online_members": with_views(
        ["member_views"],
        """
        SELECT cluster, round, observer, count(*) FILTER (WHERE state = 'ONLINE') AS n_online,
               count(*) FILTER (WHERE state = 'ONLINE' AND host = 'host-m2') = 0 AS host_absent
        FROM member_views GROUP BY cluster, round, observer""",
    ),
    "writable_primary": with_views(["writable"], "SELECT * FROM writable"),
    "primary_count_audit": with_views(
        ["writable"],
        """
        SELECT cluster, round, n_primaries,
               CASE n_primaries WHEN 0 THEN 'no_writer' WHEN 1 THEN 'ok' ELSE 'split_brain' END AS state
        FROM (SELECT cluster, round, count(*) FILTER (WHERE writable) AS n_primaries FROM writable GROUP BY cluster, round)""",
    ),
    "self_row_lookup": with_views(
        ["member_views"], "SELECT cluster, round, observer, host, state, role FROM member_views WHERE member_id = observer"
    ),
    "node_state_rollup": with_views(
        ["member_views", "reports"],
        """
        SELECT v.cluster, v.round, v.observer AS node, coalesce(o.state IN ('ONLINE', 'RECOVERING'), false) AS group_active,
               o.state AS member_state, o.role AS member_role, v.members_total, v.members_reachable,
               coalesce(f.prelog, false) AS prelog, coalesce(f.generation, 0) AS generation
        FROM (SELECT cluster, round, observer, count(*) AS members_total,
                     count(*) FILTER (WHERE state <> 'UNREACHABLE') AS members_reachable
              FROM member_views GROUP BY ALL) v
        LEFT JOIN member_views o ON o.cluster = v.cluster AND o.round = v.round AND o.observer = v.observer AND o.member_id = v.observer
        LEFT JOIN (SELECT cluster, round // 7 AS round, node, bool_or(prelog) AS prelog, max(generation) AS generation
                   FROM reports GROUP BY ALL) f ON f.cluster = v.cluster AND f.round = v.round AND f.node = v.observer""",
    ),
    "next_generation": with_views(
        ["waived"],
        """
        SELECT r.cluster, r.round, r.node, greatest(any_value(r.generation), coalesce(max(a.generation), 0)) + 1 AS next_generation
        FROM reports r JOIN (SELECT DISTINCT cluster, round, observer FROM waived) w
             ON w.cluster = r.cluster AND w.round = r.round AND w.observer = r.node
        JOIN answers a ON a.cluster = r.cluster AND a.round = r.round AND a.observer = r.node
        GROUP BY r.cluster, r.round, r.node""",
    ),
    "progress_signature": with_views(
        ["reports"],
        """
        WITH parts AS (
            SELECT user_id AS node, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS round,
                   CASE WHEN event_type = 'signup' THEN 'copy' ELSE 'received' END AS part,
                   md5(event_type || ':' || CAST(floor(value / 20) AS BIGINT)) AS digest
            FROM events),
        sums AS (SELECT node, round,
                        sum(CAST('0x' || substr(digest, 1, 16) AS UBIGINT)) FILTER (WHERE part = 'received') || '.' || sum(CAST('0x' || substr(digest, 17, 16) AS UBIGINT)) FILTER (WHERE part = 'received') AS received,
                        sum(CAST('0x' || substr(digest, 1, 16) AS UBIGINT)) FILTER (WHERE part = 'copy') || '.' || sum(CAST('0x' || substr(digest, 17, 16) AS UBIGINT)) FILTER (WHERE part = 'copy') AS copied
                 FROM parts GROUP BY node, round)
        SELECT s.node, s.round, coalesce(regexp_replace(r.txn_set, '\\s+', '', 'g'), 'none') || '|' ||
               coalesce(CAST(received AS VARCHAR), 'none') || '|' || coalesce(CAST(copied AS VARCHAR), 'none') AS signature
        FROM sums s LEFT JOIN reports r ON r.cluster * 5 + r.seed_rank = s.node AND r.round = s.round""",
    ),
    "identity_uniqueness": f"""
        WITH ids AS (SELECT s_nationkey AS cluster, {_FNV.format(name="s_name")} AS id FROM supplier)
        SELECT cluster, count(*) AS n_nodes, count(DISTINCT id) AS n_ids, count(*) = count(DISTINCT id) AS "unique",
               max(id) AS largest_id FROM ids GROUP BY cluster""",
    "derived_server_id": f"SELECT c_custkey, {_FNV.format(name='c_name')} AS server_id FROM customer",
    "donor_pick": with_views(
        ["answers"],
        """
        SELECT cluster, round, observer, peer AS donor FROM answers WHERE group_active
        QUALIFY row_number() OVER (PARTITION BY cluster, round, observer ORDER BY role = 'PRIMARY' DESC, seed_rank DESC) = 1""",
    ),
    "handoff_target": with_views(
        ["member_views"],
        """
        SELECT cluster, round, observer,
               first(member_id ORDER BY coalesce(host, ''), member_id) FILTER (
                   WHERE state = 'ONLINE' AND role = 'SECONDARY' AND member_id <> observer) AS target
        FROM member_views GROUP BY cluster, round, observer""",
    ),
    "confirmed_peer": with_views(
        ["answers", "writable"],
        """
        SELECT a.cluster, a.round // 7 AS round, a.observer, arg_min(a.peer, a.seed_rank) AS confirmed
        FROM answers a JOIN writable w ON w.cluster = a.cluster AND w.round = a.round // 7 AND w.observer = a.peer AND w.writable
        GROUP BY ALL""",
    ),
    "live_identity": with_views(["answers"], f"WITH {_IDENTITY} SELECT * FROM live"),
    "identity_collision": with_views(
        ["answers"],
        """
        SELECT a.cluster, a.round, a.observer, arg_min(a.peer, a.seed_rank) AS collides_with
        FROM answers a JOIN reports r ON r.cluster = a.cluster AND r.round = a.round AND r.node = a.observer
        WHERE a.group_active AND lower(a.uuid) = lower(r.uuid) GROUP BY ALL""",
    ),
    "pairwise_relation": with_views(["relations"], "SELECT cluster, round, observer, peer, relation FROM relations"),
    "diverged_winner": with_views(
        ["settled"], "SELECT cluster, round, observer, peer, peer_wins FROM settled WHERE relation = 'Diverged'"
    ),
    "bootstrap_verdict": with_views(
        ["settled", "declared", "waived"],
        """
        WITH expected AS (
            SELECT r.cluster, r.round, r.node AS observer, d.peer, d.seed_rank FROM reports r
            JOIN declared d ON d.cluster = r.cluster AND d.observer = r.node
            WHERE NOT EXISTS (SELECT 1 FROM waived w WHERE w.cluster = r.cluster AND w.round = r.round
                              AND w.observer = r.node AND w.peer = d.peer)),
        judged AS (
            SELECT e.*, s.group_active, s.prelog, s.my_prelog, s.my_rank,
                   CASE WHEN s.peer IS NULL THEN 'Unknown' WHEN s.peer_wins THEN 'Ahead' WHEN NOT s.peer_wins THEN 'Behind'
                        ELSE s.relation END AS final
            FROM expected e LEFT JOIN settled s
              ON s.cluster = e.cluster AND s.round = e.round AND s.observer = e.observer AND s.peer = e.peer),
        seen AS (
            SELECT cluster, round, observer, bool_or(coalesce(group_active, false)) AS live, bool_or(final = 'Unknown') AS unknown,
                   arg_min(peer, seed_rank) FILTER (WHERE final = 'Ahead') AS ahead,
                   arg_min(peer, seed_rank) FILTER (WHERE final = 'Equal' AND
                       CASE WHEN prelog <> my_prelog THEN prelog ELSE seed_rank < my_rank END) AS winner
            FROM judged GROUP BY ALL),
        verdicts AS (
            SELECT *, CASE WHEN live THEN 'JOIN' WHEN unknown THEN 'UNDECIDABLE' WHEN ahead IS NOT NULL THEN 'WAIT'
                           WHEN winner IS NOT NULL THEN 'DEFER' ELSE 'SAFE' END AS verdict FROM seen)
        SELECT r.cluster, r.round, r.node AS observer,
               CASE WHEN r.txn_set IS NOT NULL THEN coalesce(verdict, CASE WHEN r.malformed THEN 'UNDECIDABLE' ELSE 'SAFE' END) END AS verdict,
               CASE WHEN r.txn_set IS NULL THEN NULL WHEN verdict = 'WAIT' THEN ahead WHEN verdict = 'DEFER' THEN winner END AS peer
        FROM reports r LEFT JOIN verdicts v ON v.cluster = r.cluster AND v.round = r.round AND v.observer = r.node""",
    ),
    "copy_required": with_views(
        ["answers"],
        """
        SELECT r.cluster, r.round, r.node,
               coalesce(bool_or(a.group_active AND a.prelog), false) AND NOT any_value(r.prelog)
               AND coalesce(any_value(r.txn_set) = ' ', false) AS copy_required
        FROM reports r LEFT JOIN answers a ON a.cluster = r.cluster AND a.round = r.round AND a.observer = r.node
        GROUP BY r.cluster, r.round, r.node""",
    ),
    "identity_action": with_views(
        ["answers"],
        f"""WITH {_IDENTITY}
        SELECT r.cluster, r.round, r.node,
               CASE WHEN live_name IS NULL OR live_name IS NOT DISTINCT FROM r.group_name THEN 'NONE'
                    WHEN pinned THEN 'HOLD' ELSE 'ADOPT' END AS action,
               CASE WHEN live_name IS NOT NULL AND live_name IS DISTINCT FROM r.group_name AND NOT pinned
                    THEN greatest(r.generation, live_generation) ELSE r.generation END AS generation
        FROM reports r LEFT JOIN live l USING (cluster, round, node)""",
    ),
    "divergence_report": with_views(
        ["answers"],
        """
        WITH firsts AS (
            SELECT cluster, round, observer, arg_min(peer, seed_rank) AS peer FROM answers
            WHERE group_active AND txn_set IS NOT NULL GROUP BY ALL),
        both_sets AS (
            SELECT f.*, m.upto AS mine, m.txn_set LIKE '%m%' AS my_errant, p.upto AS theirs
            FROM firsts f JOIN reports m ON m.cluster = f.cluster AND m.round = f.round AND m.node = f.observer
            JOIN reports p ON p.cluster = f.cluster AND p.round = f.round AND p.node = f.peer
            WHERE NOT m.malformed AND NOT p.malformed)
        SELECT cluster, round, observer, peer, 'c' || cluster AS source, theirs + 1 AS lo, mine AS hi FROM both_sets WHERE mine > theirs
        UNION ALL SELECT cluster, round, observer, peer, observer, 1, 1 FROM both_sets WHERE my_errant""",
    ),
    "prelog_detection": with_views(
        ["reports"],
        """
        SELECT cluster, round, node, CASE WHEN checked THEN prelog OR (NOT fresh AND coalesce(txn_set = ' ', false)) END AS prelog,
               CASE WHEN checked THEN 'state' ELSE 'not_ready' END AS answer FROM reports""",
    ),
}
