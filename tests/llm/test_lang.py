from pyspark.sql import functions as F

from tidemark.llm import lang as L


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = L.op5_string_kernel(spark, sf)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    both = out.join(truth, "doc_id").where("held_out")
    right = both.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98 and out.count() == truth.count()
    assert out.where(~F.col("score").between(0, 1)).count() == 0


def test_letters_and_pieces():
    assert bytes(L.letters("Ab, 12 c!")) == b" ab c "
    rows = [("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de")] * 3
    model = L.fit(rows)
    text = "the dog and the cat und " * 40000  # many slices
    small = "the dog and the cat und " * 3
    assert abs(model.scores([text, small])[0] - model.scores([small, text])[1]).max() < 1e-5
    assert model.langs[int(model.scores(["the dog"])[0].argmax())] == "en"


def test_edges(spark):
    rows = [
        (1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "en"), (5, "123 !!", "de"), (6, "the", None),
        (None, "the dog", "en"), (7, "語言", "de"), (1, "the cat and the dog", "en"),
    ]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, lang string, score string")
    model = L.trained(docs, F.lit(True))
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in L.predicted(docs, model).collect()}
    assert got[3, None] == got[4, ""] == got[5, "123 !!"] == ("und", 0.0)
    assert got[1, "the cat and the dog"][0] == got[None, "the dog"][0] == "en" and got[2, "der hund und die katze"][0] == "de"
    assert got[7, "語言"][0] in ("de", "en")
    assert {r.lang_pred for r in L.predicted(docs, L.trained(docs, F.lit(False))).collect()} == {"und"}
    assert L.predicted(docs.limit(0), model).count() == 0


def test_repeated_rows_count_once(spark):
    ids = [*range(20), *[0] * 200, *[7] * 200]
    rows = [(i, f"text {i}" if at % 2 else f"other {i}", "en") for at, i in enumerate(ids)] + [(i, f"texte {i}", "fr") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    all_ = [(r.lang, r.text.split()[1]) for r in L.chosen_rows(docs, F.lit(True), 100).collect()]
    assert len(all_) == len(set(all_)) == 23
    few = [(r.lang, r.text.split()[1]) for r in L.chosen_rows(docs, F.lit(True), 5).collect()]
    assert len(few) == len(set(few)) == 8
    assert {lang for lang, _ in few} == {"en", "fr"}
