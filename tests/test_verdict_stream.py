"""The chain from polls to a stable verdict gives the rows of the batch twins, and streams let go of their state."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import same
from tidemark.operators import membership as M
from tidemark.operators import temporal as B
from tidemark.operators import txnset as X
from tidemark.streaming import rules as S
from tidemark.streaming import verdicts as V


def plain_relation(a, b):
    """Sets of positions, by the definition."""

    def points(text):
        found = set()
        for part in filter(None, text.split(",")):
            source, *spans = part.split(":")
            for span in spans:
                lo, _, hi = span.partition("-")
                found |= {(source, n) for n in range(int(lo), int(hi or lo) + 1)}
        return found

    a, b = points(a), points(b)
    return "Equal" if a == b else "Behind" if b < a else "Ahead" if a < b else "Diverged"


def test_text_relation(spark):
    rng = random.Random(5)

    def one():
        spans = lambda: ":".join(f"{lo}-{lo + rng.randint(0, 3)}" for lo in rng.choices(range(1, 9), k=rng.randint(1, 3)))
        return ",".join(f"{s}:{spans()}" for s in "uv" if rng.random() < 0.7)

    rows = [(one(), one()) for _ in range(300)]
    unknown = [(None, ""), ("u:1", None), ("u:3-1", "u:1"), ("u:1", "u:0-4"), ("u", "")]
    df = spark.createDataFrame(rows + unknown, "a string, b string")
    got = [tuple(r) for r in df.select("a", "b", X.text_relation(F.col("a"), F.col("b"))).collect()]
    assert got == [(a, b, plain_relation(a, b)) for a, b in rows] + [(a, b, "Unknown") for a, b in unknown]
    assert {r for _, _, r in got} == {"Equal", "Behind", "Ahead", "Diverged", "Unknown"}


def dealt(df, folder, parts):
    """``df`` as ``parts`` files without regard to its rounds."""
    for i in range(parts):
        mine = F.pmod(F.xxhash64(*[c for c in df.columns if c in ("round", "peer", "node", "cluster")]), F.lit(parts)) == i
        df.where(mine).coalesce(1).write.parquet(f"{folder}/{i:03}")


def to_the_end(spark, stream, path):
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/mark")
    done = query.trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{path}/out"), done


def fleet(spark):
    """Clusters of four nodes over 16 rounds: reports with holes, and what each node heard from most of its peers."""
    rng = random.Random(11)
    said, heard = {}, []
    for cluster in range(8):
        histories = ["c:1-9"] * 6 + ["c:1-7", "C:1-9", "c:1-5:6-9", "c:1-9,x:1", "c:9-1", None, "c:1-9, y:2"]
        for r in range(100, 116):
            for n in range(4):
                said[cluster, r, n] = (n, rng.random() < 0.2, rng.choice([None, 0, 1, 2]), rng.choice(histories if cluster % 2 else histories[:8]))
    for (cluster, r, n), _ in said.items():
        for m in set(range(4)) - {n}:
            if rng.random() < 0.04:
                continue
            seed, prelog, generation, txns = said[cluster, r, m]
            answer = "unreachable" if m == 3 or rng.random() < 0.1 else "not_ready" if rng.random() < 0.03 else "state"
            fields = (rng.random() < 0.03, prelog, generation, txns) if answer == "state" else (None,) * 4
            heard.append((cluster, f"m{n}", r, f"m{m}", None if rng.random() < 0.2 else seed, answer, *fields))
    polls = "cluster bigint, observer string, round bigint, peer string, seed_rank int, answer string, group_active boolean, prelog boolean, generation bigint, txn_set string"
    own = "cluster bigint, round bigint, node string, seed_rank int, prelog boolean, generation bigint, txn_set string"
    reports = [(c, r, f"m{n}", *v) for (c, r, n), v in said.items() if rng.random() < 0.95]
    # Nothing settles a divergence from a peer of the same generation and of no rank.
    heard.append((9, "m0", 100, "m1", None, "state", False, False, 1, "c:1-4,x:1"))
    reports.append((9, 100, "m0", 0, False, 1, "c:1-5"))
    declared = [(c, f"m{n}", f"m{m}", m) for c in range(8) for n in range(4) for m in range(4) if m != n and not (c == 7 and n == 0)] + [(9, "m0", "m1", 1)]
    return (
        spark.createDataFrame(heard, polls),
        spark.createDataFrame(reports, own),
        spark.createDataFrame(declared, "cluster bigint, observer string, peer string, seed_rank int"),
    )


@pytest.mark.parametrize("waive", [None, 1])
def test_polls_to_stable_verdict(spark, tmp_path, waive):
    S.configure(spark)
    answers, reports, declared = (df.cache() for df in fleet(spark))
    last = reports.limit(1).withColumn("cluster", F.lit(-1).cast("long")).withColumn("round", F.lit(200).cast("long"))
    dealt(answers, f"{tmp_path}/answers", 3)
    dealt(reports, f"{tmp_path}/reports", 3)
    last.coalesce(1).write.parquet(f"{tmp_path}/reports/900")
    read = lambda df, at: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{at}/*")
    verdicts = V.bootstrap_verdicts(read(answers, "answers"), read(reports, "reports"), declared, "30 seconds", waive)
    waived = None if waive is None else M.waived_peers(answers, waive)
    want = M.bootstrap_verdict(answers, reports, declared, waived).cache()
    got, _ = to_the_end(spark, verdicts, f"{tmp_path}/verdicts")
    same(got, want)
    found = {r.verdict for r in want.collect()}
    assert found >= {"SAFE", "UNDECIDABLE", "JOIN", None}
    assert waive is None or found >= {"DIVERGED", "WAIT", "DEFER"}
    stable, _ = to_the_end(spark, S.apply(verdicts, V.OBSERVER, S.stable_verdict(2)), f"{tmp_path}/stable")
    same(stable, B.stable_verdict(want, 2))
    assert stable.count() > 10


def streamed(spark, rows, tmp_path, rule, delay, forget, parts=4):
    schema = "node bigint, at_us bigint, event_id bigint, state string, signature string"
    df = spark.createDataFrame([(n, s * 1_000_000, s, v, g) for n, s, v, g in rows], schema)
    cut = max(s for _, s, _, _ in rows) // parts + 1
    for i in range(parts):
        df.where(F.expr(f"event_id div {cut} = {i}")).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        out, query = to_the_end(spark, S.apply(stream, ["node"], rule, delay, forget), tmp_path)
    return out, query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_state_of_silent_keys_goes(spark, tmp_path):
    """Each node speaks for a while and vanishes: with ``forget`` the state holds those of late only, and results agree."""
    S.configure(spark)
    rows = [(n, 20 * n + i, "ERROR", "") for n in range(60) for i in range(0, 40, 4)]
    rule = S.stuck_member(30)
    whole, kept = streamed(spark, rows, f"{tmp_path}/a", rule, "5 seconds", None)
    some, left = streamed(spark, rows, f"{tmp_path}/b", rule, "5 seconds", "60 seconds")
    same(whole, some)
    assert kept >= 60 and left < kept / 3
    assert whole.where("fired").count() > 50


def test_a_key_that_comes_back_starts_anew(spark, tmp_path):
    S.configure(spark)
    rows = [(1, s, "ERROR", "") for s in (0, 10, 20, 100, 110)] + [(2, s, "ERROR", "") for s in range(0, 400, 10)]
    got, _ = streamed(spark, rows, tmp_path, S.stuck_member(30), "5 seconds", "80 seconds")
    since = {r.at_us // 1_000_000: r.since // 1_000_000 for r in got.where("node = 1").collect()}
    assert since == {0: 0, 10: 0, 20: 0, 100: 100, 110: 100}
    assert {r.since for r in got.where("node = 2").collect()} == {0}


def test_forget_needs_a_clock(spark):
    with pytest.raises(ValueError, match="delay"):
        S.apply(spark.range(1).withColumn("at_us", F.lit(0)), ["id"], S.edge_alert(), forget="1 day")


def test_alert_names_backends(spark, tmp_path):
    S.configure(spark)
    rows = [(1, 1, 1, True, ["a"]), (1, 2, 2, False, ["a", "b"]), (1, 3, 3, False, ["c"]), (1, 4, 4, None, None), (2, 1, 5, False, [])]
    schema = "node bigint, at_us bigint, event_id bigint, primary_up boolean, backends array<string>"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got, _ = to_the_end(spark, S.apply(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["node"], S.edge_alert(True)), tmp_path)
    same(got.drop("alert"), B.edge_alert(df))
    assert {(r.event_id, tuple(r.backends)) for r in got.collect()} == {(2, ("a", "b")), (5, ())}
