"""List what lies below scan targets: the ``artifacts`` table.

Spark's own file sources skip names that begin with ``.`` or ``_`` and do not
tell links from files, so the listing starts with a Python data source,
``spark.read.format("artifact_tree")``.  It yields metadata only.  Filter the
listing first and read the content of what is left (``sources.content``): then
rejected files are never opened.

Options of the data source
    paths         JSON list of directories (local paths or URIs that pyarrow can open)
    layout        ``target``: each path is one scan target (default);
                  ``hub``: each directory directly below a path is a target
    levels        directory levels to list below a target; all of them by default
    partitions    number of listing tasks (default 64)

``read_tree`` lets the source list the top level of every target and then goes
down level by level, each a shuffle of the directories found by the one before,
so one huge target is listed by many tasks and the driver lists nothing but the
hub's own directory.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hubwarden.schemas import ARTIFACTS
from hubwarden.session import stage
from hubwarden.sources.content import spread

_ROWS = 10_000


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    size: int
    is_dir: bool
    is_link: bool
    is_file: bool


def _is_uri(path: str) -> bool:
    return "://" in path


def entries_of(path: str) -> Iterator[Entry]:
    """Entries of one directory as they come, never held together; links are reported, not resolved into."""
    if _is_uri(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        base = path.rstrip("/")
        for i in system.get_file_info(fs.FileSelector(inner, recursive=False)):
            folder, regular = i.type == fs.FileType.Directory, i.type == fs.FileType.File
            yield Entry(i.base_name, f"{base}/{i.base_name}", max(i.size or 0, 0), folder, False, regular)
        return
    with os.scandir(path) as found:
        for item in found:
            link = item.is_symlink()
            try:
                info = item.stat()
            except OSError:  # a link that leads nowhere
                info = item.stat(follow_symlinks=False)
            regular = stat.S_ISREG(info.st_mode)
            yield Entry(item.name, item.path, info.st_size if regular else 0, stat.S_ISDIR(info.st_mode), link, regular)


def list_dir(path: str) -> list[Entry]:
    """The entries of one directory by name."""
    return sorted(entries_of(path), key=lambda e: e.name)


UNREADABLE = -1  # size of a directory's row that stands for its missing entries


def walk(target: str, root: str, inside: str = "", levels: int = -1) -> Iterator[tuple]:
    """Rows of all entries below ``root/inside``, at most ``levels`` levels deep."""
    open_dirs = [(inside, 1)]
    while open_dirs:
        where, level = open_dirs.pop()
        try:
            for e in entries_of(f"{root.rstrip('/')}/{where}" if where else root):
                relpath = f"{where}/{e.name}" if where else e.name
                yield (target, relpath, e.name, relpath.count("/"), e.size, e.is_file, e.is_link, e.path)
                if e.is_dir and not e.is_link and level != levels:
                    open_dirs.append((relpath, level + 1))
        except OSError:  # not readable, or gone since it was listed: a second row of the directory says so
            yield (target, where, where.rpartition("/")[2], where.count("/") if where else -1, UNREADABLE, False, False, f"{root.rstrip('/')}/{where}")


def _is_dir(path: str) -> bool:
    if not _is_uri(path):
        return os.path.isdir(path)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.get_file_info(inner).type == fs.FileType.Directory


class ListingPartition(InputPartition):
    def __init__(self, targets: list[tuple[str, str]]):
        super().__init__(0)
        self.targets = targets


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.layout = options.get("layout", "target")
        self.levels = int(options.get("levels", -1))
        self.count = int(options.get("partitions", 64))
        if self.layout not in ("target", "hub"):
            raise ValueError("layout must be 'target' or 'hub'")

    def _targets(self) -> list[tuple[str, str]]:
        """(name, directory); a path that does not exist has no rows."""
        found = []
        for path in self.paths:
            if not _is_dir(path):
                continue
            if self.layout == "target":
                found.append((path, path))
            else:
                found.extend((e.path, e.path) for e in list_dir(path) if e.is_dir and not e.is_link)
        return found

    def partitions(self) -> list[ListingPartition]:
        targets = self._targets()
        count = max(1, min(self.count, len(targets)))
        return [ListingPartition(targets[i::count]) for i in range(count)]

    def read(self, partition: ListingPartition) -> Iterator[tuple]:
        for target, root in partition.targets:
            # the target itself, so that an empty one is still audited
            yield (target, "", "", -1, 0, False, False, root)
            yield from walk(target, root, levels=self.levels)


class ArtifactTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_tree"

    def schema(self):
        return ARTIFACTS

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def _inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries directly in the directories of a batch."""
    columns, held = ARTIFACTS.fieldNames(), []
    for batch in batches:
        for d in batch.itertuples(index=False):
            root = d.path[: len(d.path) - len(d.relpath)]
            for row in walk(d.target, root, d.relpath, levels=1):
                held.append(row)
                if len(held) >= _ROWS:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def read_tree(
    spark: SparkSession, paths: list[str], layout: str = "target", levels: int = 1, partitions: int = 64
) -> DataFrame:
    """The ``artifacts`` listing of the given directories.

    The first ``levels`` levels are listed per target.  Below them each level is
    a shuffle of the directories of the level before, written to the shared
    folder, so that one deep or broad tree is listed by all tasks and a lost
    executor costs a level.  0 lists each target in one go.
    """
    spark.dataSource.register(ArtifactTree)
    top = (
        spark.read.format("artifact_tree")
        .option("paths", json.dumps(list(paths)))
        .option("layout", layout)
        .option("levels", str(levels or -1))
        .option("partitions", str(partitions))
        .load()
    )
    if not levels:
        return top
    found = [stage(top, "listing")]
    depth = levels - 1
    while True:
        folders = found[-1].where(~F.col("is_file") & ~F.col("is_symlink") & (F.col("size") != UNREADABLE) & (F.col("depth") == depth))
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(stage(spread(folders).mapInPandas(_inside, ARTIFACTS), "listing"))
        depth += 1
