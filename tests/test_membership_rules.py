"""Pinned cases of the membership rules."""

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import membership as M


def view(spark, views):
    rows = [("c", i, me, m, f"host-{m}", s, r) for i, (me, members) in enumerate(views) for m, s, r in members]
    return spark.createDataFrame(
        rows, "cluster string, round bigint, observer string, member_id string, host string, state string, role string"
    )


P, S = "PRIMARY", "SECONDARY"
FULL = [("a", "ONLINE", P), ("b", "ONLINE", S), ("c", "ONLINE", S)]


def test_writable_primary(spark):
    cases = [
        (("a", FULL), True),
        (("b", FULL), False),
        (("A", FULL), True),
        (("a", [("a", "ONLINE", P), ("b", "UNREACHABLE", S), ("c", "UNREACHABLE", S)]), False),
        (("a", [("a", "ONLINE", P), ("b", "ONLINE", S), ("c", "UNREACHABLE", S)]), True),
        (("a", [("a", "RECOVERING", S), ("b", "ONLINE", P)]), False),
        (("a", [("a", "ONLINE", P)]), True),
        (("a", [("a", "ONLINE", P), ("b", "ERROR", S), ("c", "OFFLINE", S), ("d", "UNREACHABLE", S)]), True),
    ]
    rows = M.writable_primary(view(spark, [c for c, _ in cases])).orderBy("round").collect()
    assert [r.writable for r in rows] == [want for _, want in cases]


def test_handoff(spark):
    hosts = [("a", "aaa", P), ("x", "db-10", S), ("k", "db-2", S), ("z", "Edge", S)]
    rows = [("c", 0, "a", m, h, "ONLINE", r) for m, h, r in hosts] + [("c", 1, "a", "a", "h", "ONLINE", P)]
    df = spark.createDataFrame(rows, view(spark, [("a", FULL)]).schema)
    assert [r.target for r in M.handoff_target(df).orderBy("round").collect()] == ["z", None]


ANSWERS = (
    "cluster string, round bigint, observer string, peer string, seed_rank int, answer string, group_active boolean, "
    "state string, role string, txn_set string, prelog boolean, generation bigint, uuid string, group_name string"
)


def answers(spark, rows):
    names = [c.split()[0] for c in ANSWERS.split(", ")]
    base = {"cluster": "c", "round": 0, "observer": "me", "answer": "state", "group_active": True}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], ANSWERS)


def test_donor_ties_go_to_the_last(spark):
    rows = [{"peer": "p0", "seed_rank": 0, "role": S}, {"peer": "p1", "seed_rank": 1, "role": S}]
    assert M.donor_pick(answers(spark, rows)).first().donor == "p1"
    rows[0]["role"] = P
    assert M.donor_pick(answers(spark, rows)).first().donor == "p0"
    rows = [{"peer": "p0", "seed_rank": 0, "group_active": False}]
    assert M.donor_pick(answers(spark, rows)).count() == 0


def test_identity_collision(spark):
    me = spark.createDataFrame([("c", 0, "me", "aaaa-1111")], "cluster string, round bigint, node string, uuid string")
    rows = [
        {"peer": "p0", "seed_rank": 0, "uuid": "AAAA-1111", "group_active": False},
        {"peer": "p1", "seed_rank": 1, "uuid": "bbbb"},
        {"peer": "p2", "seed_rank": 2, "uuid": None},
        {"peer": "p3", "seed_rank": 3, "uuid": "AAAA-1111"},
        {"peer": "p4", "seed_rank": 4, "answer": "unreachable", "group_active": None},
    ]
    assert M.identity_collision(answers(spark, rows), me).first().collides_with == "p3"
    assert M.identity_collision(answers(spark, rows[:3]), me).count() == 0


def test_decide(spark):
    none = 2147483647
    cases = [
        (False, 0, [(1, "Equal"), (2, "Equal")], ("SAFE", None)),
        (False, 1, [(0, "Equal"), (2, "Equal")], ("DEFER", "p0")),
        (False, 1, [(0, "Behind"), (2, "Equal")], ("SAFE", None)),
        (False, 0, [(1, "Ahead"), (2, "Ahead")], ("WAIT", "p1")),
        (True, 2, [(0, "Equal"), (1, "Equal")], ("SAFE", None)),
        (False, 0, [(2, "Equal", True), (1, "Equal")], ("DEFER", "p2")),
        (False, 0, [(1, "Diverged"), (2, "Behind")], ("DIVERGED", "p1")),
        (False, 0, [(1, "Unknown"), (2, "Ahead")], ("UNDECIDABLE", None)),
        (False, none, [(1, "Behind"), (2, "Behind")], ("SAFE", None)),
        (False, 0, [(1, "Unknown", False, True)], ("JOIN", None)),
    ]
    rows = []
    for i, (mine, rank, peers, _) in enumerate(cases):
        for peer_rank, relation, *rest in peers:
            prelog, live = [*rest, False, False][:2]
            rows.append(("c", i, "me", f"p{peer_rank}", peer_rank, relation, prelog, rank, mine, live))
    standings = spark.createDataFrame(
        rows,
        "cluster string, round bigint, observer string, peer string, seed_rank int, relation string, prelog boolean, my_rank int, my_prelog boolean, group_active boolean",
    )
    got = [(r.verdict, r.peer) for r in M.decide(standings).orderBy("round").collect()]
    assert got == [want for *_, want in cases]


def test_divergence_has_one_loser(spark):
    rows = [(g1, r1, g2, r2) for g1 in range(3) for r1 in range(3) for g2 in range(3) for r2 in range(3) if r1 != r2]
    df = spark.createDataFrame(rows, "g1 bigint, r1 int, g2 bigint, r2 int")
    there = M.diverged_peer_wins(F.col("g1"), F.col("r1"), F.col("g2"), F.col("r2"))
    back = M.diverged_peer_wins(F.col("g2"), F.col("r2"), F.col("g1"), F.col("r1"))
    assert df.where(there == back).count() == 0
    pinned = {(0, 0, 1, 9): True, (2, 9, 1, 0): False, (1, 2, 1, 1): True, (1, 1, 1, 2): False}
    df = spark.createDataFrame(list(pinned), df.schema)
    assert [r.w for r in df.select(there.alias("w")).collect()] == list(pinned.values())


REPORTS = "cluster string, round bigint, node string, seed_rank int, txn_set string, prelog boolean, generation bigint"


def verdicts(spark, own, heard, declared=("p0", "p1"), waived=()):
    """The verdict of one node with its own set, given what its polls heard."""
    reports = spark.createDataFrame([("c", 0, "me", 5, own, False, 0), ("c", 0, "p0", 0, "u:1-3", False, 0)], REPORTS)
    rows = [{"seed_rank": int(p[1]), "group_active": False, "prelog": False, "generation": 0, "peer": p, **told} for p, told in heard.items()]
    told = spark.createDataFrame([("c", "me", p, int(p[1])) for p in declared], "cluster string, observer string, peer string, seed_rank int")
    let_go = spark.createDataFrame([("c", 0, "me", p) for p in waived], "cluster string, round bigint, observer string, peer string")
    got = {r.observer: (r.verdict, r.peer) for r in M.bootstrap_verdict(answers(spark, rows), reports, told, let_go).collect()}
    assert got["p0"] == ("SAFE", None)  # declares nobody
    return got["me"]


def test_bootstrap_needs_every_declared_peer(spark):
    behind = {"txn_set": "u:1-2"}
    assert verdicts(spark, "u:1-5", {"p0": behind, "p1": behind}) == ("SAFE", None)
    assert verdicts(spark, "u:1-5", {"p0": behind}) == ("UNDECIDABLE", None)
    assert verdicts(spark, "u:1-5", {}) == ("UNDECIDABLE", None)
    assert verdicts(spark, "u:1-5", {"p0": behind, "p1": {"answer": "unreachable"}}) == ("UNDECIDABLE", None)
    assert verdicts(spark, "u:1-5", {"p0": behind, "p1": {"answer": "unreachable"}}, waived=["p1"]) == ("SAFE", None)
    assert verdicts(spark, "u:1-5", {}, declared=[]) == ("SAFE", None)


def test_bootstrap_compares_with_the_answer(spark):
    """p0 reported three transactions, but told nine."""
    assert verdicts(spark, "u:1-5", {"p0": {"txn_set": "u:1-9"}}, declared=["p0"]) == ("WAIT", "p0")
    assert verdicts(spark, None, {"p0": {"txn_set": "u:1-9"}}, declared=["p0"]) == (None, None)
    assert verdicts(spark, "u:1-x", {"p0": {"txn_set": "u:1-2"}}, declared=["p0"]) == ("UNDECIDABLE", None)
    assert verdicts(spark, "u:1-5", {"p0": {"txn_set": "u:one"}}, declared=["p0"]) == ("UNDECIDABLE", None)
    for bad in ("u:1-10:8-2", "u:1-2-10", "u:0-4", ":1-3"):
        assert verdicts(spark, "u:1-10", {"p0": {"txn_set": bad}}, declared=["p0"]) == ("UNDECIDABLE", None)
        assert verdicts(spark, bad, {"p0": {"txn_set": bad}}, declared=["p0"]) == ("UNDECIDABLE", None)
        assert verdicts(spark, bad, {}, declared=[]) == ("UNDECIDABLE", None)
    assert verdicts(spark, "U:1-10", {"p0": {"txn_set": "u:1-10"}}, declared=["p0"]) == ("DEFER", "p0")
    diverged = {"p0": {"txn_set": "u:1-5,y:1"}}
    assert verdicts(spark, "u:1-5,x:1", diverged, declared=["p0"]) == ("WAIT", "p0")


def test_no_evidence_from_a_malformed_set(spark):
    def orphaned(own, heard):
        reports = spark.createDataFrame([("c", 0, "me", 5, own, False, 0)], REPORTS)
        rows = [{"seed_rank": i, "group_active": True, "peer": f"p{i}", "txn_set": t} for i, t in enumerate(heard)]
        return sorted((r.peer, r.source, r.lo, r.hi) for r in M.divergence_report(answers(spark, rows), reports).collect())

    assert orphaned("u:1-9", ["u:1-4:7"]) == [("p0", "u", 5, 6), ("p0", "u", 8, 9)]
    assert orphaned("u:1-9", ["u:1-x", "u:1"]) == [] == orphaned("u:1-9:3-1", ["u:1"]) == orphaned(None, ["u:1"])
    assert orphaned("u:1-9", ["U : 1-9"]) == [] and orphaned("u:1-2", [""]) == [("p0", "u", 1, 2)]


def test_waived_peers(spark):
    polls = [(r, a) for r, a in enumerate(["state", "unreachable", "unreachable", "not_ready", "unreachable"])]
    rows = [{"round": r, "peer": "p0", "seed_rank": 0, "answer": a} for r, a in polls]
    assert [r.round for r in M.waived_peers(answers(spark, rows), 1).collect()] == [2]


def test_seeds(spark):
    configs = spark.createDataFrame(
        [(1, "HOST-1", "host-1:3306, host-2:3306,host-3:3306"), (2, "x", " ,host-1:1,,"), (3, "x", "")],
        "node bigint, self string, seeds string",
    )
    got = {(r.node, r.host, r.seed_rank) for r in M.peer_list(configs).collect()}
    assert got == {(1, "host-2", 1), (1, "host-3", 2), (2, "host-1", 0)}
    assert {(r.node, r.seed_rank) for r in M.rank_of_self(configs).collect()} == {(1, 0), (2, 2147483647), (3, 2147483647)}


def fnv(name):
    h = 2166136261
    for byte in name.encode():
        h = ((h ^ byte) * 16777619) % 2**32
    return h or 1


def test_server_ids(spark):
    names = ["mysql-1", "mysql-2", "hé", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(X.fnv1a_32(F.col("n")).alias("id"))
    assert [r.id for r in df.collect()] == [fnv(n) for n in names]


def test_only_known_sets_that_differ_are_read(spark, monkeypatch):
    """Texts of malformed sets, of equal ones and of unanswered polls used to be interned, and polls joined with the malformed ones."""
    sets = {"me": "U:1-5", "n": "u:5-1", "o": None}
    reports = spark.createDataFrame([("c", 0, n, 0, s) for n, s in sets.items()], "cluster string, round bigint, node string, seed_rank int, txn_set string")
    heard = {"eq": "u: 1-5", "ahead": "u:1-9", "behind": "u:1", "bad": "u:0-3", "long": "u:9223372036854775807", "empty": " ", "none": None}
    polls = [{"observer": o, "peer": p, "seed_rank": 1, "txn_set": s} for o in [*sets, "lost"] for p, s in heard.items()]
    polls.append({"observer": "me", "peer": "mute", "seed_rank": 1, "answer": "unreachable", "txn_set": "u:7"})
    seen, interned = [], M.txnset.interned
    monkeypatch.setattr(M.txnset, "interned", lambda texts: seen.extend(r.text for r in texts.collect()) or interned(texts))
    got = M.pairwise_relation(answers(spark, polls), reports).collect()
    relations = {"eq": "Equal", "ahead": "Ahead", "behind": "Behind", "empty": "Behind"}
    assert {(r.observer, r.peer): r.relation for r in got} == {
        (p["observer"], p["peer"]): relations.get(p["peer"], "Unknown") if p["observer"] == "me" else "Unknown" for p in polls
    }
    assert len(got) == len(polls) and set(seen) == {"u:1-5", "u:1-9", "u:1", ""}


def test_verdict_queries_make_their_inputs_once(spark):
    """Polls and reports used to be made from the events again wherever a rule read them."""
    from tests.conftest import SF
    from tidemark.plans.catalog import queries

    for name in ("bootstrap_verdict", "stable_verdict"):
        assert not [f for f in queries()[name](spark, SF).inputFiles() if f.endswith("events.parquet")]
    assert len(queries()["stable_verdict"](spark, SF).inputFiles()) > 0
