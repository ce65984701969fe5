"""Published state: constant reads, versions let go of, deltas merged by size."""

import random

import pytest

from tidemark.sources import folders
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming.live_table import LiveTable

SCHEMA = "key long, seq long, op string, image string"


def test_versions_are_let_go_of(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "state"), keep=2, hold_s=0)
    for n in range(12):
        table.write(spark.range(n + 1))
    assert (table.current_version(), table.read().count()) == (11, 12)
    for kind in ("data", "published"):
        assert sorted(folders.numbered(spark, f"{table.root}/{kind}")) == [10, 11]
    table.write(spark.range(3), version=11)  # a batch that comes again
    assert table.read().count() == 3
    (tmp_path / "state" / "published" / "12").mkdir()  # named, but its row is not there yet
    assert table.current_version() == 11


def test_young_versions_are_held(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "state"), keep=2, hold_s=3600)
    held = [table.write(spark.range(n + 1)) for n in range(5)]
    assert sorted(folders.numbered(spark, f"{table.root}/data")) == held
    with pytest.raises(ValueError):
        VersionedTable(spark, "x", keep=1)


def apply(model, rows):
    for key, seq, op, image in rows:
        if seq >= model.get(key, (-1,))[0]:
            model[key] = (seq, op, image)


def shown(table):
    return {r.key: r.image for r in table.read().collect()}


def wanted(model):
    return {k: image for k, (_, op, image) in model.items() if op != "delete"}


def test_deltas_are_merged_by_size(spark, tmp_path):
    """A large first batch, then small ones: they write their own size, parts stay few, and old files go."""
    rng, model = random.Random(4), {}
    table = LiveTable(spark, str(tmp_path / "t"), ["key"], ["seq"], ["image"], buckets=2, keep=2, hold_s=0)
    first = [(k, 0, "upsert", f"a{k}") for k in range(4000)]
    apply(model, first)
    table.apply_batch(spark.createDataFrame(first, SCHEMA), 0)
    for batch in range(1, 12):
        rows = [(rng.randrange(4200), batch * 10 + i, rng.choice(["upsert", "upsert", "delete"]), f"b{batch}.{i}") for i in range(9)]
        apply(model, rows)
        table.apply_batch(spark.createDataFrame(rows, SCHEMA), batch)
        parts = table._manifest()
        assert all(p[0][0] == "0" for p in parts.values()), "the large part was written once"
        assert all(len(p) <= 6 and all(a[1] > b[1] for a, b in zip(p, p[1:])) for p in parts.values())
        written = [n for p in parts.values() for part, n in p if part.split("-")[0] == str(batch)]
        assert sum(written) <= 9 * batch
    assert shown(table) == wanted(model)
    assert sorted(folders.numbered(spark, f"{table.root}/published")) == [10, 11]
    named = {(part, b) for batch in (10, 11) for b, p in table._published(batch).items() for part, _ in p}
    there = {(part, int(n[7:])) for part in folders.names(spark, f"{table.root}/data") for n in folders.names(spark, f"{table.root}/data/{part}") if n.startswith("bucket=")}
    assert named <= there and {p for p in there if not p[0].startswith("11")} <= named


def test_replayed_and_empty_batches(spark, tmp_path):
    model = {}
    table = LiveTable(spark, str(tmp_path / "t"), ["key"], ["seq"], ["image"], buckets=3, hold_s=0, keep=2)
    assert table.read() is None
    batches = [[(k, b * 100 + k, "delete" if k % 5 == b else "upsert", f"{b}.{k}") for k in range(b, 40, b + 1)] for b in range(4)]
    for b, rows in enumerate(batches):
        apply(model, rows)
        table.apply_batch(spark.createDataFrame(rows, SCHEMA), b)
    again = LiveTable(spark, table.root, ["key"], ["seq"], ["image"], buckets=3, hold_s=0, keep=2)
    again.apply_batch(spark.createDataFrame(batches[3], SCHEMA), 3)
    again.apply_batch(spark.createDataFrame([], SCHEMA), 4)
    assert shown(again) == wanted(model) == shown(table)
    (tmp_path / "t" / "published" / "9").mkdir()  # a publication under way
    assert shown(again) == wanted(model)
