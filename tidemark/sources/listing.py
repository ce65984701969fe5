"""Listings of large archives by tasks, as a Python data source.

The driver reads folder names level by level until there are enough of them to go round, and no further; tasks list what lies below and hand
it on in pages. No object is opened.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a page, and folders to have at least before tasks take over.
PAGE, FOLDERS = 1000, 64
COLUMNS = "key string, size bigint"


def _opened(root: str):
    """The store and the path in it; ``root`` is a path of this machine or a URI of a store Arrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)
    return store, path.rstrip("/")


def _entries(store, folder: str, may_lack: bool = True):
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=may_lack))
    return [i for i in found if i.type == fs.FileType.Directory], [i for i in found if i.type == fs.FileType.File]


class Folders(InputPartition):
    """Folders of one task, each with whether those below it are the task's, too."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(None)
        self.folders = folders


class ListingReader(DataSourceReader):
    def __init__(self, root: str, least: int, tasks: int):
        self.root, self.least, self.tasks = root, least, tasks

    def partitions(self) -> list[Folders]:
        store, base = _opened(self.root)
        level, above = [base], []
        while level and len(level) < self.least:
            below = [i.path for f in level for i in _entries(store, f, may_lack=f != base)[0]]
            if not below:
                break
            above, level = above + level, below
        shares = [(f, True) for f in level] + [(f, False) for f in above]
        return [Folders(shares[i :: self.tasks]) for i in range(min(self.tasks, len(shares)))]

    def read(self, partition: Folders) -> Iterator:
        import pyarrow as pa

        store, base = _opened(self.root)
        schema = pa.schema([("key", pa.string()), ("size", pa.int64())])
        stack = list(partition.folders)
        while stack:
            folder, deep = stack.pop()
            folders, files = _entries(store, folder)
            if deep:
                stack += [(i.path, True) for i in folders]
            for at in range(0, len(files), PAGE):
                page = files[at : at + PAGE]
                yield pa.record_batch([[i.path[len(base) + 1 :] for i in page], [i.size for i in page]], schema)


class ListingSource(DataSource):
    """``spark.read.format("object_listing")`` with ``root``, and ``folders`` and ``tasks`` to say how far work is divided."""

    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> ListingReader:
        least = int(self.options.get("folders", FOLDERS))
        return ListingReader(self.options["root"], least, int(self.options.get("tasks", least)))


def list_by_tasks(spark: SparkSession, root: str, archive_id: str, folders: int = FOLDERS, tasks: int | None = None) -> DataFrame:
    """(archive_id, key, size) of every object below ``root``, keys relative to it, also of empty objects and of names that Spark's readers pass over.

    Tasks, ``folders`` of them unless ``tasks`` says otherwise, share the folders of the first level that has ``folders``. A task holds the entries of one folder. A missing
    root is an error; a folder that goes while it is listed has no rows.
    """
    spark.dataSource.register(ListingSource)
    read = spark.read.format("object_listing").option("root", root).option("folders", folders).option("tasks", tasks or folders)
    return read.load().select(F.lit(archive_id).alias("archive_id"), "key", "size")
