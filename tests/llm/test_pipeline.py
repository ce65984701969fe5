import corpus_pipeline as C
from __spark_entry__ import oracle_sql, queries
from check import compare, oracle
from tests.conftest import SF
from tests.llm import brute
from tests.llm.brute import ordered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def planted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    passage = "a passage of well over fifty words that repeats across documents " * 6
    rows = [
        (10_001, "!!! 123", "en", "s", 7), (10_002, None, "de", None, None), (10_003, "", None, "s", 0),
        (10_004, f"first start {passage}end of one", "en", "s", 1), (10_005, f"quite another start é{passage}and another end", "en", "s", 2),
        (None, "lone text without an id", None, None, None), (10_006, passage, "en", "s", 3),
    ]
    more = spark.createDataFrame(rows, docs.schema)
    return docs.unionByName(more).unionByName(docs.where("doc_id % 9 = 0"))


def test_stages_against_brute_force(spark):
    docs = planted(spark)
    names = [n for n, _ in C.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "packing"]
    first = C.written(C.language_id(spark, docs, SF))
    assert first.columns == COLUMNS
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert ordered(first.select("doc_id", "text").collect()) == ordered(r for r in given if any(c.isalpha() for c in r[1] or ""))

    second = C.written(C.near_duplicates(spark, first, SF))
    rows = [tuple(r) for r in first.select("doc_id", "text").collect()]
    groups = {}
    for (d, t), (_, n, c) in zip(rows, brute.components(rows, 5, 80)):
        groups.setdefault(c if n else (d, t), []).append((d is None, d or 0, t))
    want = [(None if void else d, t) for void, d, t in map(min, groups.values())]
    assert second.columns == COLUMNS and ordered(second.select("doc_id", "text").collect()) == ordered(want)

    third = C.written(C.repeated_passages(spark, second, SF))
    rows = [tuple(r) for r in second.select("doc_id", "text").collect()]
    cut = [(d, brute.whole_characters(t, gone)) for (d, t), gone in zip(rows, brute.removed(rows, C.PASSAGE))]
    assert third.columns == COLUMNS and ordered(third.select("doc_id", "text").collect()) == ordered(r for r in cut if r[1].strip())
    assert {r.doc_id for r in third.collect()} >= {10_004, 10_005} and 10_006 not in {r.doc_id for r in third.collect()}

    last = C.packing(spark, third, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in third.collect()}
    assert all(r.offset + r.n_tokens <= 16_384 for r in last)


def test_clashing_names_and_empty_tables(spark):
    docs = planted(spark).selectExpr("*", "'x' AS kept", "'y' AS component", "'z' AS row_key", "1 AS __key", "'p' AS lang_pred", "'q' AS n_removed")
    for table in (docs, docs.limit(0)):
        out = table
        for _, stage in C.STAGES[:3]:
            out = C.written(stage(spark, out, SF))
            assert out.columns == docs.columns and out.where("kept <> 'x' OR component <> 'y' OR row_key <> 'z' OR __key <> 1").count() == 0
        assert (C.packing(spark, out, SF).count() == 0) == (table.count() == 0)


def test_registered():
    names = {"op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "pipeline"}
    assert names <= {q.split("_")[0] for q in queries()}
    assert C.ORACLE_SQL is None and "pipeline" not in oracle_sql()


def test_sql(spark):
    duck = oracle(SF)
    for name in ("op8_chat_format", "op10_block_topk"):
        assert compare(spark, duck, name, SF).startswith("ok")
