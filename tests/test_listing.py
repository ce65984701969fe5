"""Keys of a tree, listed by tasks."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archive as A
from tidemark.sources.listing import ListingReader, list_by_tasks


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "archive"
    names = [f"base/server-{s}/{kind}/{d}/log.{n:06}" for s in range(7) for kind in ("full", "binlog") for d in range(2) for n in range(3)]
    names += ["top.txt", "base/_hidden", "base/.dot", "base/server-0/binlog/with space:and-colon"]
    for i, name in enumerate(names):
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * (i % 5))
    (root / "empty" / "below").mkdir(parents=True)
    return root, names


@pytest.mark.parametrize("folders,tasks", [(1, 1), (2, 2), (5, 3), (20, 64), (1000, 4)])
def test_every_key_once(spark, tree, folders, tasks):
    root, names = tree
    got = list_by_tasks(spark, str(root), "a", folders, tasks)
    assert sorted(r.key for r in got.collect()) == sorted(names)
    assert {r.key: r.size for r in got.collect()} == {n: i % 5 for i, n in enumerate(names)}
    assert got.rdd.getNumPartitions() <= tasks
    assert list_by_tasks(spark, root.as_uri(), "a", folders, tasks).count() == len(names)


def test_driver_reads_few_folders_and_tasks_share_the_rest(tree):
    root, names = tree
    parts = ListingReader(str(root), 5, 4).partitions()
    given = [f for p in parts for f in p.folders]
    assert len(parts) == 4 and sum(deep for _, deep in given) == 8  # the seven servers and a folder below ``empty``
    read = [sum(b.num_rows for b in ListingReader(str(root), 5, 4).read(p)) for p in parts]
    assert sum(read) == len(names) and max(read) < len(names) / 2


def test_listing_meets_the_archive_rules(spark, tree):
    root, names = tree
    keys = list_by_tasks(spark, str(root), "a")
    old = A.list_objects(spark, str(root / "base"), "a").select(F.concat(F.lit("base/"), "key").alias("key"))
    hidden, empty = {"top.txt", "base/_hidden", "base/.dot"}, set(names[::5])  # Spark's readers pass over empty files
    assert {r.key for r in keys.collect()} - {r.key for r in old.collect()} == hidden | empty
    segments = A.archive_listing(keys, "base").where("kind = 'binlog' AND seq IS NOT NULL")
    assert segments.select("lineage").distinct().count() == 7 and segments.count() == 42


def test_pages_and_lacking_folders(spark, tmp_path):
    (tmp_path / "flat").mkdir()
    for n in range(2100):
        (tmp_path / "flat" / f"k{n}").touch()
    assert [b.num_rows for p in ListingReader(str(tmp_path), 1, 1).partitions() for b in ListingReader(str(tmp_path), 1, 1).read(p)] == [1000, 1000, 100]
    (tmp_path / "none").mkdir()
    assert list_by_tasks(spark, str(tmp_path / "none"), "a").count() == 0
    with pytest.raises(Exception, match="[Nn]o such|[Nn]ot found|[Dd]oes not exist"):
        list_by_tasks(spark, str(tmp_path / "gone"), "a").count()
