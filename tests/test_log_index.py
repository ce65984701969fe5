"""The index of log segments against plain searches, on logs with late and missing stamps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import archive as A
from tidemark.operators import log_index as I

T0 = dt.datetime(2024, 3, 1)
LOG = "archive_id string, lineage string, seq bigint, pos bigint, ts timestamp, image double"
REQUESTS = "archive_id string, request_id string, lineage string, start_seq bigint, start_pos bigint, target timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def example(seed):
    """Six logs; segment numbers have holes, a fifth of the stamps is off by hours, some are missing."""
    rng, log, requests = random.Random(seed), [], []
    for n in range(6):
        archive, lineage, clock = f"a{n // 2}", f"n{n % 3}", 0
        for seq in sorted(rng.sample(range(1, 120), 70)):
            for pos in rng.sample(range(50), rng.randint(1, 4)):
                clock += rng.randint(0, 5)
                stamp = None if rng.random() < 0.05 else at(clock + rng.choice([0, 0, 0, 0, rng.randint(-600, 600)]))
                log.append((archive, lineage, seq, pos, stamp, float(pos)))
        requests += [(archive, f"{n}/{k}", lineage, rng.randint(0, 125), rng.randint(0, 50), at(rng.randint(-50, 900))) for k in range(40)]
    return log, requests


def plain(log, request):
    """The rows a request replays, and its stop."""
    archive, _, lineage, start_seq, start_pos, target = request
    rows = sorted((((r[2], r[3]), r[4]) for r in log if r[:2] == (archive, lineage)), key=lambda r: r[0])
    rows = [r for r in rows if r[0][0] > start_seq or (r[0][0] == start_seq and r[0][1] >= start_pos)]
    stop = next((place for place, ts in rows if ts is not None and ts >= target.replace(microsecond=0)), None)
    return [place for place, _ in rows if stop is None or place < stop], [place for place, _ in rows], stop


@pytest.mark.parametrize("fan_bits", [1, 2, 6])
def test_stops_like_a_plain_search(spark, fan_bits, monkeypatch):
    monkeypatch.setattr(I, "FAN_BITS", fan_bits)
    log, requests = example(fan_bits)
    rows, asked = spark.createDataFrame(log, LOG), spark.createDataFrame(requests, REQUESTS)
    index = I.segment_index(rows, ["archive_id", "lineage"])
    assert index.levels == {1: 7, 2: 4, 6: 2}[fan_bits]
    placed = I.located(index, asked).cache()
    stops = {r.request_id: (r.stop and (r.stop.seq, r.stop.pos)) for r in I.stop_places(rows, index, placed).collect()}
    assert stops == {r[1]: plain(log, r)[2] for r in requests}
    for name, run, part in (("stop", A.stop_cut, 0), ("all", A.start_coordinate_filter, 1)):
        got = {}
        for r in run(rows, asked, index).collect():
            got.setdefault(r.request_id, []).append((r.seq, r.pos))
        assert {k: sorted(v) for k, v in got.items()} == {r[1]: p for r in requests if (p := plain(log, r)[part])}, name
    placed.unpersist()


def test_rows_joined(spark):
    """A request meets no row behind its stop's segment, and to find the stop the rows of two segments at most."""
    log, requests = example(9)
    rows, asked = spark.createDataFrame(log, LOG), spark.createDataFrame(requests, REQUESTS)
    index = I.segment_index(rows, ["archive_id", "lineage"])
    placed = I.stop_places(rows, index, I.located(index, asked))
    segments = I.replay_segments(index, placed).collect()
    assert all(r.start_seq <= r.seq and (r.stop is None or r.seq <= r.stop.seq) for r in segments)
    want = {(q[1], place[0]) for q in requests for place in plain(log, q)[1] if plain(log, q)[2] is None or place[0] <= plain(log, q)[2][0]}
    assert {(r.request_id, r.seq) for r in segments} >= want
    behind = F.col("_first") + F.col("_starts").cast("bigint")
    found = I.first_reaching(index, placed.select(*index.keys, "request_id", behind.alias("place"), F.col("target").alias("instant")))
    assert found.groupBy("request_id").count().where("count > 1").count() == 0


def test_edges(spark):
    log = [("a", "n", 5, 1, at(0), 1.0), ("a", "n", 5, 2, None, 1.0), ("a", "n", None, 3, at(99), 1.0), ("a", None, 5, 1, at(9), 1.0)]
    asked = [("a", "r1", "n", 5, 2, at(0)), ("a", "r2", "n", 1, 0, at(0)), ("a", "r3", "n", 6, 0, at(0)), ("a", "r4", "x", 5, 0, at(0)), ("a", "r5", None, 5, 0, at(0)), ("a", "r6", "n", 5, 1, None)]
    rows, requests = spark.createDataFrame(log, LOG), spark.createDataFrame(asked, REQUESTS)
    got = sorted((r.request_id, r.seq, r.pos) for r in A.stop_cut(rows, requests).collect())
    assert got == [("r1", 5, 2), ("r6", 5, 1), ("r6", 5, 2)]
    assert A.stop_cut(rows.limit(0), requests).count() == 0 == A.stop_cut(rows, requests.limit(0)).count()
    plain_log = rows.drop("archive_id")
    assert A.start_coordinate_filter(plain_log, requests.drop("archive_id")).count() == 2 + 1 + 2
