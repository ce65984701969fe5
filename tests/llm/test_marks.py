import numpy as np

from tidemark.llm import marks

U = np.uint64


def test_bitmap_does_not_collect_rows(spark, monkeypatch):
    """Shares come to the driver as Arrow batches, compressed; hashes that occur twice are marked, and no counter is too small."""
    rnd = np.random.default_rng(3)
    few = rnd.integers(0, 1 << 63, 3000, dtype=np.int64)
    rows = spark.createDataFrame([(int(h),) for h in [*few, *few[:700]]], "h long")

    def each(b):
        yield b.column(0).to_numpy().view(U)

    blobs = rows.mapInArrow(marks.packing(each), marks.BLOBS)
    packed = [b for b in marks._twice([marks.packed(few.view(U))])]
    assert sum(len(b.column(c)[0].as_py()) for b in packed for c in ("blob", "slots")) < len(packed) * 200  # of 5,120 bytes each

    def refused(self):
        raise AssertionError("rows were collected")

    monkeypatch.setattr(type(blobs), "collect", refused)
    sent, slots, n = marks.bitmap(blobs)
    assert n == 3700
    found = marks.marked(few.view(U), sent)
    assert found[:700].all() and found[700:].mean() < 0.02
    counts = np.frombuffer(slots, "<u4")
    assert counts.sum() == 3700 and (counts[(few[:700].view(U) >> U(44)).astype(np.int64)] >= 2).all()
    none, slots, n = marks.bitmap(rows.where("h is null").mapInArrow(marks.packing(each), marks.BLOBS))
    assert n == 0 and not marks.marked(few.view(U), none).any() and not any(slots)
