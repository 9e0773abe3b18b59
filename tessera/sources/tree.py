"""A Python data source for trees of files: regular files only, hidden and empty ones included, links not followed.

Spark's own reader of binary files leaves out empty files and names that begin with a dot or an underscore, and follows
links. The folder must be one that every executor reaches under the same path. Tasks list the directories; the driver
only finds as many of them as keep the tasks busy. Files are then dealt over tasks by their sizes and read there.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.schemas import FILES

#: Files and bytes that one task reads on the whole.
TASK_FILES, TASK_BYTES = 2048, 64 << 20
#: Directories that the driver looks for at most before tasks go on.
DIRECTORIES = 512


class Directory(InputPartition):
    """A directory of a root, alone or with all below it."""

    def __init__(self, root: int, path: str, deep: bool):
        super().__init__(path)
        self.root, self.path, self.deep = root, path, deep


def listed(root: str, here: str) -> Iterator[tuple[str, os.stat_result]]:
    """Relative paths with `/` and the status of what stands in a directory, names in order."""
    with os.scandir(os.path.join(root, here)) as entries:
        for e in sorted(entries, key=lambda e: os.fsencode(e.name)):
            yield f"{here}/{e.name}" if here else e.name, e.stat(follow_symlinks=False)


def walk(root: str, top: str = "", deep: bool = True) -> Iterator[tuple[str, os.stat_result]]:
    """Relative paths and the status of all regular files below a directory, or only of those in it."""
    stack = [top]
    while stack:
        below = []
        for path, status in listed(root, stack.pop()):
            if stat.S_ISDIR(status.st_mode):
                below.append(path)
            elif stat.S_ISREG(status.st_mode):
                path.encode()  # a name that isn't UTF-8 is an error
                yield path, status
        stack += reversed(below) if deep else ()


def _directories(root: str, here: str) -> list[str]:
    with os.scandir(os.path.join(root, here)) as entries:
        return sorted(f"{here}/{e.name}" if here else e.name for e in entries if e.is_dir(follow_symlinks=False))


class TreeReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        flat, todo = [], deque((k, "") for k in range(len(self.roots)))
        while todo and len(todo) < DIRECTORIES and len(flat) < DIRECTORIES:
            k, here = todo.popleft()
            flat.append(Directory(k, here, False))
            todo += [(k, path) for path in _directories(self.roots[k], here)]
        return [*flat, *(Directory(k, here, True) for k, here in todo)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root = self.roots[partition.root]
        for path, status in walk(root, partition.path, partition.deep):
            name = f"{os.path.basename(os.path.normpath(root))}/{path}" if len(self.roots) > 1 else path
            yield name, status.st_size, status.st_mtime_ns // 10**9, status.st_mtime_ns % 10**9, status.st_mode, None


class TreeSource(DataSource):
    """Options: path (one folder, or several with the system's path separator between). The content is left null."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self):
        return FILES

    def reader(self, schema) -> DataSourceReader:
        roots = [p for p in self.options["path"].split(os.pathsep) if p]
        names = [os.path.basename(os.path.normpath(r)) for r in roots]
        if len(set(names)) != len(names):
            raise ValueError("two roots have one name")
        return TreeReader(roots)


def opener(roots: tuple[str, ...]) -> Callable[[str], BinaryIO]:
    """Opens a path of read_tree() over the same roots."""
    by_name = {os.path.basename(os.path.normpath(r)): r for r in roots}

    def open_(path: str) -> BinaryIO:
        if len(roots) == 1:
            return open(os.path.join(roots[0], path), "rb")
        name, _, rest = path.partition("/")
        return open(os.path.join(by_name[name], rest), "rb")

    return open_


def dealt(files: DataFrame) -> DataFrame:
    """Files dealt over tasks that read some `TASK_BYTES` or `TASK_FILES` each."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return files.repartition(max(1, -(-n // TASK_FILES), -(-size // TASK_BYTES)))


def read_tree(spark: SparkSession, *roots: str, content: bool = True) -> DataFrame:
    """The files below one or more folders; below several, paths begin with the folder's name.

    With content each file's bytes are one value, which has at most 2 GB; chunking.streamed() reads files of any size.
    """
    spark.dataSource.register(TreeSource)
    files = spark.read.format("filetree").option("path", os.pathsep.join(roots)).load()
    if not content:
        return files
    open_, names = opener(roots), [f.name for f in FILES.fields]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                with open_(path) as f:
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(k, 1) for i in range(len(names) - 1)), pa.array([f.read()], pa.binary())], names)

    return dealt(files).mapInArrow(load, FILES)


def totals(files: DataFrame) -> DataFrame:
    """One row: files and bytes."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
