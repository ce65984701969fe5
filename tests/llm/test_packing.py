import random

from tidemark.llm import packing as K
from tests.conftest import SF
from tests.llm.brute import ordered


def naive(items, capacity):
    """The tightest compatible bin by looking at all of them."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [
            (capacity - used, b)
            for b, (used, sources, clusters) in enumerate(bins)
            if capacity - used >= size and not (source is not None and source in sources) and not (cluster is not None and cluster in clusters)
        ]
        b = min(fits)[1] if fits else len(bins)
        if b == len(bins):
            bins.append((0, set(), set()))
        used, sources, clusters = bins[b]
        out.append((b, used))
        bins[b] = used + size, sources | {source}, clusters | {cluster}
    return out


def test_best_fit():
    rng = random.Random(1)
    for _ in range(60):
        items = [(rng.randint(0, 40), rng.choice([None, "hot", "hot", *"abcdefgh"]), rng.choice([None, *range(30)])) for _ in range(150)]
        items.sort(key=lambda x: -x[0])
        assert K.best_fit(items, 40) == naive(items, 40)


def check(rows, capacity):
    bins, docs = {}, {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["cluster"]), []).append((r["start"], r["n_tokens"]))
        bins.setdefault(r["bin"], []).append(r)
    for inside in bins.values():
        at = 0
        for r in sorted(inside, key=lambda r: (r["offset"], r["n_tokens"])):
            assert r["offset"] == at
            at += r["n_tokens"]
        assert at <= capacity
        for key in ("source", "cluster"):
            named = [r[key] for r in inside if r[key] is not None]
            assert len(named) == len(set(named))
    return docs


def test_table(spark):
    docs = check(K.op3_conflict_best_fit(spark, SF).collect(), K.CAPACITY)
    sizes = {(r.doc_id, r.cluster): r["size"] for r in K.measured(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(docs) == set(sizes)
    for key, parts in docs.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == sizes[key]


def test_edges(spark):
    rows = [(1, "hot", "c", 5)] * 30 + [(2, None, None, 25), (3, "s", None, None), (4, "s", "d", -3), (None, "t", "e", 10), (None, None, None, 0)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, cluster string, size int, bin int").repartition(4)
    out = K.packed(docs, "size", "source", "cluster", capacity=10)
    got = out.collect()
    check(got, 10)
    assert len(got) == 30 + 3 + 4 and len({r.bin for r in got if r.source == "hot"}) == 30
    assert ordered(out.collect()) == ordered(K.packed(docs.repartition(2), "size", "source", "cluster", capacity=10).collect())
    assert K.packed(docs.limit(0), "size", "source", "cluster").count() == 0
