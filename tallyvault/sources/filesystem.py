"""A file tree as a table of entries: one row a file, directory, link or other thing.

Nothing is opened and no link is followed.  The driver lists the top levels until there
are enough directories to deal over tasks; each task walks its own breadth first.  What cannot be looked at becomes a
row with an `error` and the walk goes on.  The tree must be where all executors see it.
"""

from __future__ import annotations

import json
import os
import stat
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallyvault import storage
from tallyvault.errors import Refused
from tallyvault.storage import settle

#: What an inventory store leaves beside its files.
OWN_SUFFIXES = (".wal", ".lock", ".tmp")
#: A row's kind for a directory that a round was given and has listed.
LISTED = "LISTED"
SCHEMA = "relative_path string, filename string, kind string, size long, modified_sec long, modified_nano int, error string"


def kind_of(mode: int) -> str:
    return "SYMLINK" if stat.S_ISLNK(mode) else "DIRECTORY" if stat.S_ISDIR(mode) else "FILE" if stat.S_ISREG(mode) else "OTHER"


def row(root: str, relative: str) -> tuple:
    name = relative.rpartition("/")[2]
    try:
        s = os.lstat(os.path.join(root, relative))
    except OSError as e:
        return relative, name, "OTHER", 0, 0, 0, f"{type(e).__name__}: {e.strerror}"[:4096]
    kind = kind_of(s.st_mode)
    seconds, nanos = divmod(s.st_mtime_ns, 1_000_000_000)
    return relative, name, kind, s.st_size if kind == "FILE" else 0, seconds, nanos, None


#: How many levels the driver lists at most, until so many directories or entries are found; and the tasks that they are dealt to at most.
MOST_LEVELS, ENOUGH, MOST_LISTED, MOST_TASKS = 8, 512, 200_000, 4096


class Subtrees(InputPartition):
    def __init__(self, starts: list[str], deep: bool):
        super().__init__((len(starts), deep))
        self.starts, self.deep = starts, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        excluded = options.get("exclude") or ""
        self.start = json.loads(options["start"]) if options.get("start") else None
        self.excluded = {os.path.realpath(p) + end for p in excluded.split(os.pathsep) if p for end in ("", *OWN_SUFFIXES)}

    def names(self, relative: str) -> list[str]:
        folder = os.path.join(self.root, relative)
        with os.scandir(folder) as found:
            names = sorted(e.name for e in found)
        return [f"{relative}/{n}" if relative else n for n in names if os.path.join(os.path.realpath(folder), n) not in self.excluded]

    def partitions(self) -> list[Subtrees]:
        """What the driver has listed, entry by entry, and the subtrees below, dealt over tasks.

        Directories are listed level by level until there are enough of them, so a tree whose
        files are all under one top directory is still walked by many tasks.
        """
        alone, open_ = [""], [""]
        self.names("")  # a root that cannot be listed is refused
        shown = [""]  # has a row already
        for level in range(MOST_LEVELS):
            if not open_ or (level and (len(open_) >= ENOUGH or len(alone) >= MOST_LISTED)):
                break
            below: list[str] = []
            for at in open_:
                try:
                    names = self.names(at)
                except OSError:  # told by the task that has its row
                    names = []
                for name in names:
                    (below if self.is_folder(name) else alone).append(name)
            alone += [at for at in open_ if at not in shown] if level else []
            open_ = below
        tasks = []
        for starts, deep, n in ((alone, False, -(-len(alone) // 1000)), (open_, True, len(open_))):
            n = min(MOST_TASKS, n)
            tasks += [Subtrees(starts[i::n], deep) for i in range(n)]
        return tasks

    def is_folder(self, relative: str) -> bool:
        try:
            return stat.S_ISDIR(os.lstat(os.path.join(self.root, relative)).st_mode)
        except OSError:
            return False

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        queue = deque(partition.starts)
        while queue:
            at = queue.popleft()
            found = row(self.root, at)
            if found[2] == "DIRECTORY" and at:
                try:
                    names = self.names(at)
                    if partition.deep:
                        queue.extend(names)
                except OSError as e:
                    found = (*found[:-1], f"{type(e).__name__}: {e.strerror}"[:4096])
            yield found


class FileTree(DataSource):
    """`spark.read.format("file_tree").load(root)`; option `exclude` names files that are never listed."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)


class RoundReader(TreeReader):
    """A part of a walk: what is below the given directories, as far as each task gets.

    A task lists no further directory when it has found so many entries.  What it has found
    by then has a row each, directories that it has not listed as `open`; of the given
    directories it tells which it has listed.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options["most"])

    def partitions(self) -> list[Subtrees]:
        n = min(MOST_TASKS, len(self.start))
        return [Subtrees(self.start[i::n], True) for i in range(n)]

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        queue, count = deque((at, True) for at in partition.starts), 0
        while queue:
            at, given = queue.popleft()
            found = (at, "", LISTED, 0, 0, 0, None) if given else row(self.root, at)
            late = found[2] in ("DIRECTORY", LISTED) and count >= self.most
            if found[2] in ("DIRECTORY", LISTED) and not late:
                try:
                    names = self.names(at)
                    count += len(names)
                    queue.extend((n, False) for n in names)
                except OSError as e:
                    found = (*found[:-1], f"{type(e).__name__}: {e.strerror}"[:4096])
            if not (given and late):
                yield (*found, late)


class FileTreeRound(FileTree):
    """`file_tree` with options `start` and `most`: one round of a walk."""

    @classmethod
    def name(cls) -> str:
        return "file_tree_round"

    def schema(self) -> str:
        return f"{SCHEMA}, open boolean"

    def reader(self, schema: StructType) -> RoundReader:
        return RoundReader(self.options)


def top(root: str) -> tuple:
    """The root's own entry; refused if it cannot be listed."""
    try:
        os.listdir(root.removeprefix("file://") or "/")
    except OSError as e:
        raise Refused(f"{root} cannot be listed: {e.strerror}") from e
    return row(root.removeprefix("file://"), "")[:-1]


def discover(spark: SparkSession, root: str, scan_id: int, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """entries and scan_errors of a tree, walked at once.

    Ids rise with depth and then path from 1, the root, so that a parent's is below its
    children's.
    """
    spark.dataSource.register(FileTree)
    read = spark.read.format("file_tree").option("exclude", os.pathsep.join(exclude or [])).load(root)
    return _placed(read, scan_id, 1, None)


def round_of(spark: SparkSession, root: str, scan_id: int, folders: DataFrame, first: int, most: int, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries (with `open`) and scan_errors of a round below some directories (entry_id, relative_path; a round's, so not many), with ids from `first`, and which of these it listed.

    A task has `most` entries and what its last directory adds.
    """
    spark.dataSource.register(FileTreeRound)
    known = folders.select("entry_id", "relative_path")
    starts = [r["relative_path"] for r in known.collect()]
    read = spark.read.format("file_tree_round").option("exclude", os.pathsep.join(exclude or [])).option("start", json.dumps(starts)).option("most", most).load(root)
    told = settle(read)
    entries, errors = _placed(told.filter(F.col("kind") != LISTED), scan_id, first, known)
    listed = told.filter(F.col("kind") == LISTED)
    return entries, errors.unionByName(_errors(listed, scan_id)), listed.select("relative_path")


def _errors(rows: DataFrame, scan_id: int) -> DataFrame:
    return rows.filter("error is not null").select(
        F.lit(scan_id).cast("long").alias("scan_id"), F.lit("DISCOVERY").alias("phase"), "relative_path", F.col("error").alias("message"), F.unix_millis(F.current_timestamp()).alias("recorded_at_ms")
    )


def _placed(read: DataFrame, scan_id: int, first: int, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Found things with ids from `first` and their parents', which are among them or `known`."""
    found = read.withColumn("_level", F.when(F.col("relative_path") == "", 0).otherwise(F.size(F.split("relative_path", "/"))))
    numbered = settle(storage.numbered(found, ["_level", "relative_path"], "entry_id").withColumn("entry_id", F.col("entry_id") + (first - 1)))
    parents = numbered.filter("kind = 'DIRECTORY'").select(F.col("relative_path").alias("_folder"), F.col("entry_id").alias("_parent"))
    if known is not None:
        parents = parents.unionByName(known.select(F.col("relative_path").alias("_folder"), F.col("entry_id").alias("_parent")))
    folder = F.when(F.col("_level") <= 1, F.lit("")).otherwise(F.expr("left(relative_path, length(relative_path) - length(filename) - 1)"))
    placed = numbered.withColumn("_folder", F.when(F.col("_level") > 0, folder)).join(parents, "_folder", "left")
    shown = ["relative_path", "filename", "kind", "size", "modified_sec", "modified_nano", *(["open"] if "open" in read.columns else [])]
    entries = placed.select(F.lit(scan_id).cast("long").alias("scan_id"), "entry_id", F.coalesce("_parent", F.lit(0)).alias("parent_id"), *shown)
    return entries, _errors(numbered, scan_id)
