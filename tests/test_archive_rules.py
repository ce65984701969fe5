"""Pinned cases of the archive rules, and random ones against a walk written plainly."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import archive as A
from tidemark.operators import replay as R
from tidemark.operators import telemetry as E
from tidemark.plans import recovery
from tidemark.sources import archive as S
from tidemark.sources.versioned import VersionedTable


def at(clock, day=13):
    return datetime.fromisoformat(f"2026-08-{day}T{clock}")


def name(seq):
    return f"binlog.{seq:06d}"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


def make_fulls(spark, rows):
    full = [("ar", lineage, f"{lineage}/{t.isoformat()}", t, name(1), 1, 4) for lineage, t in rows]
    return spark.createDataFrame(
        full, "archive_id string, lineage string, dump_key string, taken_at timestamp, start_file string, start_seq bigint, start_pos bigint"
    )


def make_targets(spark, *instants):
    return spark.createDataFrame(
        [("ar", str(i), t) for i, t in enumerate(instants)], "archive_id string, request_id string, target timestamp"
    )


FULLS = [("q", at("02:15:30")), ("q", at("06:40:00")), ("k", at("07:05:09")), ("q", at("21:10:00"))]


def test_newest_full(spark):
    targets = make_targets(spark, at("20:00:00"), at("06:40:00"), at("02:15:29"))
    rows = {r.request_id: r for r in A.newest_full_asof(targets, make_fulls(spark, FULLS)).collect()}
    assert (rows["0"].lineage, rows["0"].taken_at) == ("k", at("07:05:09"))
    assert (rows["1"].lineage, rows["1"].taken_at) == ("q", at("06:40:00"))
    assert rows["2"].lineage is None


def test_newest_full_tie(spark):
    tied = make_fulls(spark, [("n", at("03:30:00")), ("t", at("03:30:00")), ("e", at("03:30:00"))])
    assert A.newest_full_asof(make_targets(spark, at("03:30:00")), tied).first().lineage == "t"


def test_fallback_fulls(spark):
    rows = A.fallback_fulls(make_fulls(spark, FULLS[:3])).orderBy("rank").collect()
    lines = [r.line for r in rows if r.dump_key != f"q/{at('06:40:00').isoformat()}"]
    assert lines == [
        "server-k full taken at 2026-08-13T07:05:09.000Z",
        "server-q full taken at 2026-08-13T02:15:30.000Z",
    ]
    assert {r.others for r in rows} == {2}
    assert A.fallback_fulls(make_fulls(spark, FULLS[:1])).first().others == 0


def plan(spark, seqs, start, names=None):
    names = names or [name(s) for s in seqs]
    rows = [("l", s, n, at("10:00:00")) for s, n in zip(seqs, names, strict=True)]
    segments = spark.createDataFrame(rows, "lineage string, seq bigint, name string, last_ts timestamp")
    starts = spark.createDataFrame([("l", start, name(start))], "lineage string, start_seq bigint, start_file string")
    r = A.replay_plan(segments, starts).first()
    return r.run_length, r.run_last, r.gap_after, r.gap_next


def test_replay_plan(spark):
    assert plan(spark, [11, 12, 13, 14, 17, 18], 13) == (2, name(14), name(14), name(17))
    assert plan(spark, [11, 12, 17], 40) == (0, None, None, None)
    assert plan(spark, [6, 20, 22], 9) == (0, None, "", name(20))
    assert plan(spark, [99, 101, 100, 98], 99) == (3, name(101), None, None)
    # Two files of one number are a gap; a file of the start's number is not past it.
    assert plan(spark, [7, 7, 8], 7, [name(7), "other.000007", name(8)])[0] == 1
    assert plan(spark, [30, 31, 31, 32], 30) == (2, name(31), name(31), name(31))
    assert plan(spark, [5, 6], 5, ["other.000005", name(6)]) == (0, None, "", name(6))
    assert plan(spark, [5], 5, ["other.000005"]) == (0, None, None, None)


def walk_plan(seqs, start):
    if start not in seqs:
        later = [s for s in sorted(seqs) if s > start]
        return (0, None, "" if later else None, name(later[0]) if later else None)
    run = []
    for s in sorted(seqs):
        if s < start:
            continue
        if run and s != run[-1] + 1:
            return (len(run), name(run[-1]), name(run[-1]), name(s))
        run.append(s)
    return (len(run), name(run[-1]), None, None)


def test_replay_plan_random(spark):
    rng = random.Random(7)
    cases = {f"l{i}": (set(rng.sample(range(1, 12), rng.randint(0, 10))), rng.randint(0, 12)) for i in range(300)}
    rows = [(k, s, name(s), at("10:00:00")) for k, (seqs, _) in cases.items() for s in seqs]
    segments = spark.createDataFrame(rows, "lineage string, seq bigint, name string, last_ts timestamp")
    starts = spark.createDataFrame(
        [(k, start, name(start)) for k, (_, start) in cases.items()], "lineage string, start_seq bigint, start_file string"
    )
    got = {
        r.lineage: (r.run_length, r.run_last, r.gap_after, r.gap_next)
        for r in A.replay_plan(segments, starts, rows_per_task=4).collect()
    }
    assert got == {k: walk_plan(*c) for k, c in cases.items()}


def cut(spark, disk, active, uploaded=(), lost=()):
    schema = "lineage string, seq bigint, name string"
    on_disk = spark.createDataFrame([("l", s, name(s)) for s in disk], schema)
    ledger = [("l", name(s), "uploaded") for s in uploaded] + [("l", name(s), "lost") for s in lost]
    ledger = spark.createDataFrame(ledger, "lineage string, name string, status string")
    actives = spark.createDataFrame([("l", active)], "lineage string, active_seq bigint")
    row = A.purge_cut(on_disk, actives, ledger).first()
    return row and row.cut_seq


def test_purge_cut(spark):
    assert cut(spark, [20, 21, 22, 25, 26], 26, [20, 21, 22, 25]) == 26
    assert cut(spark, [20, 21, 22, 25, 26], 26, [20, 21, 25]) == 22
    assert cut(spark, [20, 21, 22, 25, 26], 26, [20, 25], [21, 22]) == 26
    assert cut(spark, [20, 21, 22], 22, [21]) is None
    assert cut(spark, [8], 8) is None
    assert cut(spark, [], 8) is None


def test_recovery_bound(spark):
    huge = 9223372036854775807
    rows = [
        (at("14:00:00"), at("14:00:00"), 60, 180, True),
        (at("14:00:00"), at("14:05:00"), 60, 180, True),
        (at("14:00:00"), at("13:57:00"), 60, 180, True),
        (at("14:00:00"), at("13:56:59"), 60, 180, False),
        (at("14:00:00"), at("13:00:00"), 30, 120, False),
        (at("14:00:00"), at("13:59:00"), 0, 60, True),
        (at("14:00:00"), at("13:00:00"), huge, huge, True),
    ]
    points = spark.createDataFrame([r[:3] for r in rows], "target timestamp, achieved timestamp, rotate_s bigint")
    got = A.recovery_bound(points).collect()
    assert [(r.bound_s, r.within) for r in got] == [r[3:] for r in rows]


def test_event_headers(spark):
    good = {
        "#260813 14:00:02 server id 1  end_log_pos 157": at("14:00:02"),
        "#260813  1:02:03 server id 1  end_log_pos 157": at("01:02:03"),
        "#991231 23:59:59 server id 1": datetime(1999, 12, 31, 23, 59, 59),
    }
    bad = [
        "", "# at 4", "#26081 14:00:02 server id 1", "#260813 14:00 server id 1", "#260813 14:00:02:03 server id 1",
        "#261313 14:00:02 server id 1", "INSERT '#260813 14:00:02 server id 1'", "#700101  0:00:00 server id 1",
        "#260813 14:00:60 server id 1", "#260230 14:00:02 server id 1", "#260813 14:00:02 serverid 1",
    ]
    lines = spark.createDataFrame([(x,) for x in [*good, *bad]], "line string").withColumn("n", F.col("line"))
    assert {r.n: r.ts for r in S.event_header_scan(lines).collect()} == good


def test_dump_coordinates(spark):
    heads = {
        "new": ["x", "-- CHANGE REPLICATION SOURCE TO SOURCE_LOG_FILE='binlog.000003', SOURCE_LOG_POS=157;"],
        "old": ["CHANGE MASTER TO MASTER_LOG_FILE='binlog.000003', MASTER_LOG_POS=157;"],
        "none": ["-- nothing"],
        "half": ["-- CHANGE MASTER TO MASTER_LOG_FILE='b.1'", "CHANGE MASTER TO MASTER_LOG_FILE='b.2', MASTER_LOG_POS=1"],
    }
    rows = [(f, i, line) for f, lines in heads.items() for i, line in enumerate(lines)]
    got = S.dump_coordinate_scan(spark.createDataFrame(rows, "file string, line_no bigint, line string")).collect()
    assert {(r.file, r.start_file, r.start_pos) for r in got} == {
        ("new", "binlog.000003", 157),
        ("old", "binlog.000003", 157),
    }


def test_listing(spark):
    keys = ["binlog/server-u/full/t.sql.gz", "binlog/server-u/binlog/binlog.000002", "unrelated/key", "binlog/server-/full/x", "binlog2/server-u/full/x"]
    objects = spark.createDataFrame([("ar", k) for k in keys], "archive_id string, key string")
    for base in ["/binlog", "binlog", "/binlog/", "binlog/"]:
        rows = {(r.lineage, r.kind, r.name, r.seq) for r in S.archive_listing(objects, base).collect()}
        assert rows == {("u", "full", "t.sql.gz", None), ("u", "binlog", name(2), 2)}
    rooted = spark.createDataFrame([("ar", "server-u/full/t")], "archive_id string, key string")
    assert [r.lineage for base in ("/", "") for r in S.archive_listing(rooted, base).collect()] == ["u", "u"]


def test_read_files(spark, tmp_path):
    folder = tmp_path / "binlog" / "server-u" / "full"
    folder.mkdir(parents=True)
    good = '{"taken_at": "2026-08-13T10:00:00.5Z",\n "binlog_file": "binlog.000003", "binlog_pos": 157, "server_uuid": "x", "mysql_version": "8"}'
    (folder / "t1.meta.json").write_text(good)
    (folder / "t2.meta.json").write_text("{torn")
    (folder / "t1.sql.gz").write_text("-- CHANGE MASTER TO MASTER_LOG_FILE='b.3', MASTER_LOG_POS=7;\n")
    texts = S.read_backup_texts(spark, str(tmp_path), "ar")
    row = S.full_backup_scan(texts, "binlog").first()
    assert (row.lineage, row.start_seq, row.start_pos, row.dump_key) == ("u", 3, 157, "binlog/server-u/full/t1.sql.gz")
    assert S.full_backup_rejects(texts, "binlog").count() == 1
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        listed = S.archive_listing(S.list_objects(spark, root, "ar"), "binlog").collect()
        assert {(r.key, r.lineage, r.kind) for r in listed} == {
            (f"binlog/server-u/full/{n}", "u", "full") for n in ("t1.meta.json", "t2.meta.json", "t1.sql.gz")
        }
    assert S.read_lines(spark, str(folder / "t2.meta.json")).first().line == "{torn"


def test_times(spark):
    assert one(spark, X.parse_rfc3339, "2026-08-13T14:00:00Z") == at("14:00:00")
    assert one(spark, X.parse_rfc3339, "2026-08-13T16:00:00.5+02:00") == at("14:00:00.500000")
    assert one(spark, X.parse_rfc3339, "2026-08-13") is None
    assert one(spark, X.parse_rfc3339, "2026-08-13T14:00:00") is None
    assert one(spark, X.parse_rfc3339, "2026-13-13T14:00:00Z") is None
    assert one(spark, X.log_seq, "binlog.000010") == 10
    assert one(spark, X.log_seq, "binlog.index") is None


def test_failure_directions(spark):
    assert tuple(one(spark, X.heal_ledger, "2 1000\n")) == (2, 1000)
    assert one(spark, X.heal_ledger, "2").attempts == 2147483647
    assert one(spark, X.heal_ledger, None).attempts == 0
    assert one(spark, X.counter_or_zero, "x") == 0
    volumes = ["absent", "open", "done", "bare", "junk", "empty"]
    texts = [
        ("open", '{"status": "in_progress", "target_time": "t", "updated_at": "u"}'),
        ("done", '{"status": "completed", "target_time": "t", "achieved_time": "a", "updated_at": "u"}'),
        ("bare", '{"status": "completed", "target_time": "t", "updated_at": "u"}'),
        ("junk", "not json"),
        ("empty", ""),
    ]
    got = E.run_marker_status(
        spark.createDataFrame([(v,) for v in volumes], "volume string"),
        spark.createDataFrame(texts, "volume string, marker_text string"),
    )
    assert {r.volume for r in got.where("crashed").collect()} == {"open", "junk", "empty"}


def test_upsert_and_conflict(spark):
    schema = "key bigint, seq bigint, pos bigint, op string, image string"
    log = spark.createDataFrame(
        [(2, 1, 4, "insert", "w2-ahead"), (2, 1, 9, "upsert", "w3-reformed"), (3, 1, 5, "insert", "x"), (3, 2, 1, "delete", None), (91, 1, 7, "insert", "from-primary")],
        schema,
    )
    base = spark.createDataFrame([(1, "kept"), (3, "old")], "key bigint, image string")
    folded = R.fold(base, log, ["key"], ["seq", "pos"], ["image"])
    assert {(r.key, r.image) for r in folded.collect()} == {(1, "kept"), (2, "w3-reformed"), (91, "from-primary")}
    assert R.fold(base, log.limit(0), ["key"], ["seq", "pos"], ["image"]).count() == 2
    replica = spark.createDataFrame([(91,), (1,)], "key bigint")
    assert [r.key for r in R.apply_conflicts(replica, log, ["key"], ["seq", "pos"]).collect()] == [91]


def test_stop_is_a_prefix(spark):
    t = at("14:00:00")
    schema = "lineage string, seq bigint, pos bigint, ts timestamp, key bigint, op string, image string"
    log = spark.createDataFrame(
        [("l", 1, 2, t - timedelta(hours=9), 1, "upsert", "before the start"), ("l", 1, 4, t - timedelta(seconds=9), 1, "upsert", "in"), ("l", 2, 1, t + timedelta(microseconds=100), 2, "upsert", "same second"), ("l", 2, 3, t - timedelta(seconds=5), 3, "upsert", "earlier stamp")],
        schema,
    )
    ready = spark.createDataFrame(
        [("r", "l", "d", 1, 4, t + timedelta(milliseconds=500), "OK"), ("no", "l", "d", 1, 4, t, "SHORT")],
        "request_id string, lineage string, dump_key string, start_seq bigint, start_pos bigint, target timestamp, verdict string",
    )
    base = spark.createDataFrame([("l", "d", 9, "dump"), ("l", "other", 8, "dump")], "lineage string, dump_key string, key bigint, image string")
    rows = recovery.point_in_time_table(base, log, ready).collect()
    assert {tuple(r) for r in rows} == {("r", 1, "in"), ("r", 9, "dump")}


def test_gap_before_or_after_the_target(spark):
    fulls = make_fulls(spark, [("a", at("10:00:00"))])
    rows = [("a", s, name(s), at(c)) for s, c in [(1, "11:00:00"), (2, "13:00:00"), (4, "15:00:00")]]
    segments = spark.createDataFrame(rows, "lineage string, seq bigint, name string, last_ts timestamp")
    targets = make_targets(spark, at("12:30:00"), at("14:00:00"))
    strict = recovery.restore_readiness(targets, fulls, segments).orderBy("request_id").collect()
    assert [r.verdict for r in strict] == ["GAP", "GAP"]
    aware = recovery.restore_readiness(targets, fulls, segments, target_aware=True).orderBy("request_id").collect()
    assert [r.verdict for r in aware] == ["OK", "GAP"]


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "state"))
    assert table.read() is None
    table.write(spark.range(3))
    table.write(spark.range(5))
    assert (table.current_version(), table.read().count()) == (1, 5)
    table.write(spark.range(4), version=1)
    spark.range(9).write.parquet(str(tmp_path / "state" / "data" / "2"))  # never published
    assert (table.current_version(), table.read().count()) == (1, 4)


def test_a_lineage_in_two_archives(spark):
    """A copied bucket neither doubles a lineage's segments nor fills its holes."""
    rows = [(a, "u", name(n), n, at("10:00:00")) for a, have in (("a", (1, 2, 3)), ("b", (1, 3))) for n in have]
    segments = spark.createDataFrame(rows, "archive_id string, lineage string, name string, seq bigint, last_ts timestamp")
    starts = spark.createDataFrame([(a, "u", 1, name(1)) for a in "ab"], "archive_id string, lineage string, start_seq bigint, start_file string")
    got = {r.archive_id: (r.run_length, r.gap_after, r.gap_next) for r in A.replay_plan(segments, starts).collect()}
    assert got == {"a": (3, None, None), "b": (1, name(1), name(3))}
    requests = starts.select("archive_id", "lineage", "start_seq", F.lit(0).cast("bigint").alias("start_pos"), F.concat(F.lit("r"), "archive_id").alias("request_id"))
    log = segments.select("archive_id", "lineage", "seq", F.lit(4).cast("bigint").alias("pos"))
    counts = {r.request_id: r["count"] for r in A.start_coordinate_filter(log, requests).groupBy("request_id").count().collect()}
    assert counts == {"ra": 3, "rb": 2}
