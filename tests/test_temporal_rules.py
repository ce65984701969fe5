"""Pinned cases of the time rules, telemetry and edge rules."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import telemetry as E
from tidemark.operators import temporal as B
from tidemark.sources import logs as S

SECOND = 1_000_000


def polls(spark, rows, column, kind="string"):
    data = [(1, t * SECOND, i, v) for i, (t, v) in enumerate(rows)]
    return spark.createDataFrame(data, f"node bigint, at_us bigint, event_id bigint, {column} {kind}")


def test_dwell(spark):
    rows = [(0, "gone"), (30, "gone"), (59, "gone"), (60, "gone"), (61, "ok"), (70, "gone"), (80, None), (90, "gone"), (151, "gone")]
    got = B.continuous_dwell(polls(spark, rows, "verdict"), 60).orderBy("at_us").collect()
    assert [(r.at_us // SECOND, r.fired) for r in got] == [
        (0, False), (30, False), (59, False), (60, True), (70, False), (90, False), (151, True),
    ]


def test_stuck(spark):
    rows = [
        (0, "RECOVERING", "a"), (50, "RECOVERING", "a"), (100, "ERROR", ""), (160, "RECOVERING", "b"),
        (200, "OFFLINE", ""), (210, "RECOVERING", "b"), (270, "RECOVERING", "b"), (280, "ONLINE", ""),
        (290, "RECOVERING", "b"), (300, None, None), (310, "ERROR", ""), (400, "ERROR", ""),
    ]
    data = [(1, t * SECOND, i, s, sig) for i, (t, s, sig) in enumerate(rows)]
    df = spark.createDataFrame(data, "node bigint, at_us bigint, event_id bigint, state string, signature string")
    got = B.stuck_member(df, 60).orderBy("at_us").collect()
    assert [(r.at_us // SECOND, r.since // SECOND, r.fired) for r in got] == [
        (0, 0, False), (50, 0, False), (100, 0, True), (160, 160, False), (210, 210, False),
        (270, 210, True), (290, 290, False), (310, 310, False), (400, 310, True),
    ]


def test_streak(spark):
    events = ["planned_stop", "start", "planned_stop", "start", "start", "start", "ready", "planned_stop", "start", "start", "planned_stop", "planned_stop", "planned_stop", "start"]
    got = B.failure_streak(polls(spark, list(enumerate(events)), "event"), 3).orderBy("at_us").collect()
    assert [r.streak for r in got] == [0, 1, 0, 1, 2, 3, 0, 0, 1, 2, 1, 0, 0, 1]
    assert [i for i, r in enumerate(got) if r.alert] == [5]


def test_heal_gate_arithmetic(spark):
    cases = [
        ((0, None, 1000), "GO"), ((1, 1000, 1030), "BACKOFF"), ((1, 1000, 1060), "GO"), ((2, 1000, 1119), "BACKOFF"),
        ((2, 1000, 1120), "GO"), ((3, 1000, 2**62), "CAP"), ((2147483647, None, 5), "CAP"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "n int, last bigint, now bigint")
    verdict = B.heal_verdict(F.col("n"), F.col("last"), F.col("now"), 3, 60)
    assert [r.v for r in df.select(verdict.alias("v")).collect()] == [v for _, v in cases]
    gaps = spark.createDataFrame([(0, 60), (1, 60), (2, 60), (3, 60), (40, 60), (2, 2**62)], "n int, base bigint")
    got = [r.g for r in gaps.select(B.backoff_gap_seconds(F.col("n"), F.col("base")).alias("g")).collect()]
    assert got == [0, 60, 120, 240, 60 * 2**16, 2**63 - 1]


def test_edge_alert(spark):
    rows = list(enumerate([None, False, None, False, True, False, None, True]))
    assert [r.event_id for r in B.edge_alert(polls(spark, rows, "primary_up", "boolean")).orderBy("at_us").collect()] == [1, 5]


def test_fall_rise(spark):
    rows = list(enumerate([True, False, False, True, False, True, True, False]))
    got = [r.up for r in B.fall_rise(polls(spark, rows, "passed", "boolean")).orderBy("at_us").collect()]
    assert got == [None, None, False, False, False, False, True, True]


def test_incidents(spark):
    runs = [(1, 0, 5, 0), (1, 10, 15, 1), (1, 20, 80, 2), (1, 90, 95, 3), (1, 100, 159, 4)]
    df = spark.createDataFrame([(n, s * SECOND, e * SECOND, i) for n, s, e, i in runs], "node bigint, start_us bigint, end_us bigint, event_id bigint")
    assert [r.event_id for r in B.incident_dedupe(df).orderBy("start_us").collect()] == [0, 2]


def test_transitions(spark):
    rows = list(enumerate(["a", "a", None, None, "b", "a"]))
    got = B.transitions(polls(spark, rows, "state"), "state", ["node"], ["at_us", "event_id"]).orderBy("at_us").collect()
    assert [(r.event_id, r.state) for r in got] == [(0, "a"), (2, None), (4, "b"), (5, "a")]


def test_envelope(spark):
    schema = "type string, node string, role string, old_role string, new_role string, process string, exit_code int, backends array<string>, component string, error string, context string"
    rows = [
        ("NodeStarted", "n", "PRIMARY", *[None] * 8),
        ("RoleChanged", "n", None, "a", "b", *[None] * 6),
        ("ProcessDied", "n", None, None, None, "server", 137, *[None] * 4),
        ("ProcessDied", "n", None, None, None, "server", None, *[None] * 4),
        ("NoPrimary", *[None] * 6, ["x", "y"], None, None, None),
        ("ComponentError", *[None] * 7, "c", "e", "ctx"),
    ]
    got = E.event_envelope(spark.createDataFrame(rows, schema)).collect()
    assert [r.message for r in got] == [
        "node n is up in the role PRIMARY",
        "node n went from role a to role b",
        "on n the process server ended, exit code 137",
        "on n the process server ended, exit code unknown",
        "none of these backends is a healthy primary: x, y.",
        "c could not finish ctx (e)",
    ]
    assert json.loads(got[3].payload) == {"type": "ProcessDied", "node": "n", "process": "server", "exit_code": None}
    assert len({r.kind for r in got}) == 5


def test_deliveries(spark):
    cases = [(200, '{"errors": [1]}', "rejected: graphql errors"), (200, '{"data": true}', "sent"), (400, '{"errors": [1]}', "rejected: http status"), (503, "", "rejected: http status"), (200, "errors", "sent"), (299, "", "sent"), (300, "", "rejected: http status")]
    df = spark.createDataFrame([c[:2] for c in cases], "status int, body string")
    assert [r.outcome for r in E.delivery_outcome(df).collect()] == [c[2] for c in cases]


def test_edge_statistics(spark):
    def line(proxy, server, status):
        return ",".join([proxy, server, *[""] * 15, status, "", ""])

    lines = [("down", line("p", "BACKEND", "UP")), ("down", line("p", "s1", "UP 1/2")), ("down", line("q", "s1", "UP")), ("up", line("p", "s1", "DOWN")), ("up", line("p", "s2", "UP")), ("up", "p,s1,UP")]
    rows = S.edge_stats_scan(spark.createDataFrame(lines, "poll string, line string"))
    assert rows.count() == 5
    assert {r.poll: r.up for r in E.backend_up_any(rows, "p").collect()} == {"down": False, "up": True}


def test_log_signals(spark):
    lines = ['{"message": "lost f1", "file": "f1"}', '{"message": "lost f2", "file": "f2"}', '{"message": "fine", "file": "f1"}', "junk"]
    files = spark.createDataFrame([("f1",)], "file string")
    got = S.log_signal_scan(spark.createDataFrame([(x,) for x in lines], "line string"), files, "^lost").collect()
    assert [(r.file, r.message) for r in got] == [("f1", "lost f1")]


def test_events_by_kind(spark):
    rows = [("NoPrimary", datetime(2026, 1, 1, 3)), ("NoPrimary", datetime(2026, 1, 1, 4)), ("NodeStarted", datetime(2026, 1, 2))]
    got = E.events_by_kind(spark.createDataFrame(rows, "type string, ts timestamp"), prefix="x").collect()
    assert {(r.window_start.day, r.kind, r.n) for r in got} == {(1, "x.no_primary", 2), (2, "x.node_started", 1)}
