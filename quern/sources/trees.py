"""Source trees as a data source: folders are partitions, and what a scan leaves out is never opened.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("purpose", "index").load("/srv/project")

The driver opens folders from the root, those that are left out excepted, until there are about PARTITIONS to deal out; the tasks walk on
from there with the same pruning and read the files. So neither the names nor the texts of a large tree pass through the driver.
The tree has to be in a folder that all executors see.

Purposes are those of ``tables.SCANS``, and ``docs``: Markdown below the folder ``.agent``. Files that can't be read, and bytes that are no
UTF-8, give a null text and replaced characters; symbolic links to folders are not followed; an absent root is an empty tree.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions import fixed
from quern.sources.tables import SCANS

#: Folders that are dealt out, about.
PARTITIONS = 256


def rules(purpose: str) -> tuple[Callable[[str], bool], Callable[[str], bool]]:
    """Whether to open a folder, and whether to read a file, by name."""
    if purpose == "docs":
        return lambda folder: True, lambda name: name.endswith(".md") and name not in fixed.DOCS_EXCLUDED
    extensions, excluded, hidden = SCANS[purpose]
    ends, out = frozenset(extensions), frozenset(excluded)

    def read(name: str) -> bool:
        end = os.path.splitext("x" + name)[1]
        return (end if hidden else end.lower()) in ends

    return lambda folder: folder not in out and (hidden or not folder.startswith(".")), read


def listed(folder: str, purpose: str, scan: Callable = os.scandir) -> tuple[list[str], list[str]]:
    """Names of the folders to open and of the files to read in one folder, in order."""
    enter, read = rules(purpose)
    folders, files = [], []
    try:
        with scan(folder) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if enter(e.name):
                        folders.append(e.name)
                elif read(e.name):
                    files.append(e.name)
    except (FileNotFoundError, NotADirectoryError, PermissionError):
        pass
    return sorted(folders), sorted(files)


def walk(root: str, below: str, purpose: str, scan: Callable = os.scandir) -> Iterator[str]:
    """Paths (below ``root``) of the files at and below a folder."""
    open_ = [below]
    while open_:
        at = open_.pop()
        folders, files = listed(os.path.join(root, at), purpose, scan)
        yield from (os.path.join(at, f) for f in files)
        open_ += [os.path.join(at, f) for f in reversed(folders)]


class Part(InputPartition):
    """Folders, and whether what is below them is read as well."""

    def __init__(self, folders: list[str], deep: bool):
        self.folders, self.deep = folders, deep


class SourceTree(DataSource):
    """path (below the root), text, size, modified (seconds since 1970)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, text string, size bigint, modified double"

    def reader(self, schema) -> DataSourceReader:
        root, purpose = self.options["path"].removeprefix("file://"), self.options.get("purpose", "index")
        return TreeReader(os.path.join(root, ".agent") if purpose == "docs" else root, purpose, ".agent/" if purpose == "docs" else "", int(self.options.get("partitions", PARTITIONS)))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, purpose: str, prefix: str, count: int):
        self.root, self.purpose, self.prefix, self.count = root, purpose, prefix, count

    def partitions(self) -> list[InputPartition]:
        """Folders whose own files are read, and folders that are walked to the ground."""
        level, flat = [""], []
        while level and len(level) + len(flat) < self.count:
            flat += level
            level = [os.path.join(f, name) for f in level for name in listed(os.path.join(self.root, f), self.purpose)[0]]
        deal = lambda folders, deep: [Part(folders[k :: self.count], deep) for k in range(min(self.count, len(folders)))]
        return deal(flat, False) + deal(level, True)

    def read(self, partition: Part) -> Iterator[tuple]:
        own = lambda at: (os.path.join(at, f) for f in listed(os.path.join(self.root, at), self.purpose)[1])
        for p in (p for at in partition.folders for p in (walk(self.root, at, self.purpose) if partition.deep else own(at))):
            full = os.path.join(self.root, p)
            try:
                at = os.stat(full)
                with open(full, "rb") as f:
                    text = f.read().decode("utf-8", "replace")
                yield self.prefix + p, text, at.st_size, at.st_mtime
            except FileNotFoundError:
                continue
            except OSError:
                yield self.prefix + p, None, None, None


def write_tree(files: DataFrame, root: str, path: str = "path", text: str = "text") -> int:
    """Write each row as a file below ``root``, a folder that all executors see; returns how many. A null text is an empty file."""
    root = root.removeprefix("file://")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, x in zip(*(c.to_pylist() for c in b.columns)):
                full = os.path.join(root, p)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                # a task that is tried again replaces what it wrote
                with open(f"{full}.part", "w", encoding="utf-8", newline="") as f:
                    f.write(x or "")
                os.replace(f"{full}.part", full)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return files.select(path, text).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
