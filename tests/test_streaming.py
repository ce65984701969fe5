"""Every stream gives the rows of its batch twin, also across a restart in the middle."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import membership as M
from tidemark.operators import temporal as B
from tidemark.operators.replay import latest_per_key
from tidemark.streaming import rules as S
from tidemark.streaming.cadence import cadence_overdue
from tidemark.streaming.live_table import LiveTable

HOURS = 3600


def split_files(df, by, folder, parts=4):
    """``df`` as files in the order of ``by``, for one file per micro-batch."""
    df = df.orderBy(by).cache()
    cuts = df.approxQuantile(by, [i / parts for i in range(1, parts)], 0)
    edges = [None, *cuts, None]
    for i in range(parts):
        piece = df
        if edges[i] is not None:
            piece = piece.where(F.col(by) > edges[i])
        if edges[i + 1] is not None:
            piece = piece.where(F.col(by) <= edges[i + 1])
        piece.coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
        yield f"{folder}/{i}"
    df.unpersist()


def run(spark, df, by, rule, keys, tmp_path):
    """The rule over the first files, a restart from the checkpoint, and the rest."""
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    S.configure(spark)
    for i, _ in enumerate(split_files(df, by, source)):
        if i % 2 == 0:
            continue
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        query = S.apply(stream, keys, rule).writeStream.format("parquet").option("path", out)
        query = query.option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out)


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    assert rows(left) == rows(right)


CASES = {
    "dwell": (S.continuous_dwell(6 * HOURS), lambda p: B.continuous_dwell(p, 6 * HOURS)),
    "stuck": (S.stuck_member(6 * HOURS), lambda p: B.stuck_member(p, 6 * HOURS)),
    "streak": (S.failure_streak(), B.failure_streak),
    "alert": (S.edge_alert(), lambda p: B.edge_alert(p).withColumn("alert", F.lit(True))),
    "fall_rise": (S.fall_rise(), B.fall_rise),
    "transitions": (S.transitions("state"), lambda p: B.transitions(p, "state", ["node"], ["at_us", "event_id"])),
}


@pytest.mark.parametrize("name", CASES)
def test_stream_equals_batch(spark, tables, tmp_path, name):
    rule, batch = CASES[name]
    polls = tables.polls
    same(run(spark, polls, "at_us", rule, ["node"], tmp_path), batch(polls))


def shuffled(spark, polls, rule, delay, parts, tmp_path, then=()):
    """The rule over polls dealt to ``parts`` files without regard to time, then over files of one row each."""
    S.configure(spark)
    for i in range(parts):
        polls.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
    for i, extra in enumerate(then):
        time.sleep(1)  # files are read in the order of their times
        extra.coalesce(1).write.parquet(f"{tmp_path}/in/{parts + i:03}")
    stream = spark.readStream.schema(polls.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = S.apply(stream, ["node"], rule, delay).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    query.option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_shuffled_arrival(spark, tables, tmp_path, parts):
    """Any order within the delay, in batches of any size, gives the rows of the batch twin; later rows are shown."""
    polls = tables.polls.select("node", "event_id", "at_us", "state", "signature").cache()
    low, high = polls.agg(F.min("at_us"), F.max("at_us")).first()
    days = (high - low) // 86_400_000_000 + 1
    end = high + days * 86_400_000_000 + 1_000_000
    last = polls.limit(1).withColumn("node", F.lit(-1).cast("long")).withColumn("at_us", F.lit(end))
    late = polls.orderBy("at_us").limit(1).withColumn("event_id", F.lit(-7).cast("long"))
    got = shuffled(spark, polls, S.stuck_member(6 * HOURS), f"{days} days", parts, tmp_path, [last, late])
    assert [(r.event_id, r.at_us, r.state) for r in got.where("late").collect()] == [(-7, low, None)]
    same(got.where("NOT late").drop("late"), B.stuck_member(polls, 6 * HOURS))
    polls.unpersist()


def test_order_is_demanded_without_a_delay(spark, tables, tmp_path):
    with pytest.raises(Exception, match="rows out of order"):
        shuffled(spark, tables.polls, S.stuck_member(6 * HOURS), None, 3, tmp_path)


def test_incidents(spark, tables, tmp_path):
    ended = F.col("at_us") + (F.col("value") * B.MICROS).cast("bigint")
    runs = tables.polls.select("node", F.col("at_us").alias("start_us"), ended.alias("end_us"), "event_id")
    got = run(spark, runs, "start_us", S.incident_dedupe(), ["node"], tmp_path)
    same(got.drop("alert"), B.incident_dedupe(runs))


def test_stable_verdict(spark, tables, tmp_path):
    verdicts = M.bootstrap_verdict(tables.answers, tables.reports, tables.declared)
    got = run(spark, verdicts, "round", S.stable_verdict(2), ["cluster", "observer"], tmp_path)
    same(got, B.stable_verdict(verdicts, 2))


def test_heal_admission_against_a_walk(spark, tables, tmp_path):
    cap, base, reset = 3, 6 * HOURS, 8 * HOURS
    got = run(spark, tables.polls, "at_us", S.heal_admission(cap, base, reset), ["node"], tmp_path)
    want, nodes = [], {}
    for r in tables.polls.orderBy("at_us", "event_id").collect():
        s = nodes.setdefault(r.node, {"n": 0, "last": 0, "online": None})
        if r.state == "ONLINE":
            s["online"] = s["online"] or r.at_us
            if r.at_us - s["online"] >= reset * 1_000_000:
                s["n"], s["last"] = 0, 0
        else:
            s["online"] = None
        if r.attempt:
            now = r.at_us // 1_000_000
            pause = 0 if s["n"] == 0 else base * 2 ** (s["n"] - 1)
            verdict = "CAP" if s["n"] >= cap else "BACKOFF" if now < s["last"] + pause else "GO"
            want.append((r.event_id, s["n"], verdict))
            if verdict == "GO":
                s["n"], s["last"] = s["n"] + 1, now
    found = [tuple(r) for r in got.select("event_id", "attempts_before", "verdict").collect()]
    assert sorted(found) == sorted(want)
    assert {v for _, _, v in want} == {"GO", "BACKOFF", "CAP"}


def test_live_table(spark, tables, tmp_path):
    log = tables.change_log.select("lineage", "key", "seq", "pos", "op", "image")
    table = LiveTable(spark, f"{tmp_path}/table", ["lineage", "key"], ["seq", "pos"], ["image"], buckets=8)
    for i, _ in enumerate(split_files(log, "seq", f"{tmp_path}/in", 3)):
        if i == 1:
            continue
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        table.start(stream, f"{tmp_path}/mark").awaitTermination()
    want = latest_per_key(log, ["lineage", "key"], ["seq", "pos"], ["op", "image"]).where("op <> 'delete'").drop("op")
    same(table.read(), want)
    # An old batch that comes again changes nothing.
    table.apply_batch(log.where("seq = 1"), 99)
    same(table.read(), want)


def test_cadence(spark, tables, tmp_path):
    S.configure(spark)
    log = tables.change_log.select("lineage", "ts").withColumn("at", F.unix_micros("ts"))
    list(split_files(log, "at", f"{tmp_path}/in", 6))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    silent = cadence_overdue(stream.where("lineage <> 'n0' OR ts < '2024-01-10'"), 4 * 86400, delay="0 seconds")
    query = silent.writeStream.format("memory").queryName("silent").outputMode("append")
    query.option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
    assert {r.lineage for r in spark.table("silent").collect()} == {"n0"}


def test_cadence_when_all_are_silent(spark, tables, tmp_path):
    """On the machines' clock the past is long over: every lineage is overdue, and one that never sent anything."""
    S.configure(spark)
    log = tables.change_log.select("lineage", "ts")
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    log.limit(1).select(F.lit("never").alias("lineage"), "ts").write.parquet(f"{tmp_path}/told")
    read = lambda at: spark.readStream.schema(log.schema).parquet(f"{tmp_path}/{at}")
    silent = cadence_overdue(read("in"), 86400, declared=read("told")).writeStream.format("memory").queryName("all_silent").outputMode("append")
    query = silent.option("checkpointLocation", f"{tmp_path}/mark").trigger(processingTime="1 second").start()
    wanted = {r.lineage for r in log.select("lineage").distinct().collect()} | {"never"}
    found = set()
    try:  # such a stream goes on for ever, since time does
        for _ in range(90):
            time.sleep(1)
            found = {r.lineage for r in spark.table("all_silent").collect()}
            if found == wanted:
                break
    finally:
        query.stop()
    assert found == wanted
