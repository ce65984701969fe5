import xxhash
from pyspark.sql import functions as F

from tidemark.llm import sharding as S
from tests.llm.brute import ordered

M = 1 << 64


def spark_hash(*longs: int) -> int:
    h = 42
    for x in longs:
        h = xxhash.xxh64(x.to_bytes(8, "little", signed=True), seed=h).intdigest()
    return h - M if h >= M >> 1 else h


def permuted(x: int, n: int, seed: int) -> int:
    """The network and its walk in plain integers."""
    a, b = S.sides(n)
    while True:
        left, right = divmod(x, b)
        for r in range(S.ROUNDS):
            if r % 2 == 0:
                left = (left + spark_hash(seed, r, right) % a) % a
            else:
                right = (right + spark_hash(seed, r, left) % b) % b
        x = left * b + right
        if x < n:
            return x


def test_permutation_and_its_inverse(spark):
    for n in (1, 2, 3, 10, 997, 4096):
        rows = spark.range(n).select("id", S.position_of(F.col("id"), n, 5).alias("p"))
        got = rows.collect()
        assert {r.id: r.p for r in got} == {i: permuted(i, n, 5) for i in range(n)}
        assert sorted(r.p for r in got) == list(range(n))
        back = rows.select("id", S.row_at(F.pmod("p", F.lit(3)), F.call_function("div", F.col("p"), F.lit(3)), n, 3, 5).alias("r"))
        assert all(r.id == r.r for r in back.collect())


def test_place_agrees_with_the_table(spark):
    docs = spark.createDataFrame([(i * 7 % 101, f"t{i}") for i in range(101)], "doc_id long, text string").repartition(7)
    out = S.feistel_shards(docs, ["doc_id"], 8, seed=3)
    shard, slot = S.place(F.col("doc_id"), 101, 8, 3)
    assert out.where((F.col("row_number") != F.col("doc_id")) | (shard != F.col("shard")) | (slot != F.col("slot"))).count() == 0
    again = S.feistel_shards(docs.repartition(3), ["doc_id"], 8, seed=3)
    assert ordered(out.collect()) == ordered(again.collect())


def test_counts_slots_copies_nulls_and_clashing_names(spark):
    rows = [(1, None, 0)] * 40 + [(None, "x", 1), (None, "y", 2), (3, "", 3), (3, "é" * 5000, 4), (4, "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    out = S.feistel_shards(docs, ["doc_id"], 4)
    assert out.columns == ["doc_id", "text", "row_number", "position", "shard", "slot"]
    got = out.collect()
    counts = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert ordered((r.doc_id, r.text) for r in got) == ordered((a, b) for a, b, _ in rows)


def test_empty(spark):
    assert S.feistel_shards(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], 8).count() == 0


def test_no_python_on_the_main_path(spark, capsys, tmp_path):
    from tests.conftest import SF

    S.op7_feistel_shards(spark, SF).explain()
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
