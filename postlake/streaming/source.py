"""Message files as a stream (STR1): a Python data source that finds new files by the stamps of their folders.

``spark.readStream.format("maildir").load(root)`` gives (path, mtime, size) of the files in each cur or new folder that changed since
the last batch. Folders are walked and listed by tasks, one per part of the tree; names with ':' and folders with a leading dot are read
like others, and subtrees with a marker are not entered. A changed folder gives all its files, so compare them with what is stored,
as ``streams.stream_index`` does.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.maildir import _list_children, local_root, markers_of, walk_from

SCHEMA = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us")), ("size", pa.int64())])


class TreePart(InputPartition):
    """Trees to walk, and the range of folder stamps (ns) that a batch covers; own: their own cur and new only."""

    def __init__(self, dirs: list[str], start: int, end: int, own: bool):
        self.dirs, self.start, self.end, self.own = dirs, start, end, own


class MaildirStreamReader(DataSourceStreamReader):
    """Offsets are times: a batch covers the folders whose stamp is after its start and up to its end.

    A folder that changes after the end, while the batch runs, has a later stamp and belongs to the next batch, with all its files.
    The end is ``settle`` seconds ago, for file systems whose clock or resolution differs. A folder without a stamp is in every batch.
    """

    def __init__(self, options: dict):
        self.root = local_root(options["path"])
        self.settle = float(options.get("settle", "2"))
        self.parts = int(options.get("parts", "64"))
        self.markers = markers_of(str(options.get("full", "false")).lower() == "true")

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The tree cut into subtrees: levels from the root on are listed here until there are ``parts`` of them, or a few hundred
        folders are listed; all else is walked by the tasks."""
        seen, edge, left = [], [self.root], 300
        while edge and len(edge) < self.parts and left > 0:
            rows = list(walk_from(edge[:left], self.markers, min(left, len(edge))))
            if edge == [self.root] and rows and rows[0][1] == "failed":
                raise FileNotFoundError(f"{self.root}: not a folder that can be listed")
            seen += [r[0] for r in rows if r[1] == "maildir"]
            edge, left = [r[0] for r in rows if r[1] == "dir"] + edge[left:], left - len(edge)
        deal = lambda dirs, own: [TreePart(dirs[k::self.parts], start["ns"], end["ns"], own) for k in range(min(self.parts, len(dirs)))]
        return deal(seen, True) + deal(edge, False)

    def read(self, part: TreePart) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        found = walk_from(part.dirs, self.markers, len(part.dirs) if part.own else None)
        for d, kind, *stamps in found:
            if kind != "maildir":
                continue
            for name, stamp in zip(("cur", "new"), stamps):
                if stamp is not None and not part.start < stamp <= part.end:
                    continue
                folder = f"{d.rstrip('/')}/{name}"
                try:
                    infos = _list_children(folder)[0]
                except OSError:  # as a batch index: nothing is known of its files
                    continue
                if self.markers & {i.base_name for i in infos}:
                    continue
                files = [i for i in infos if i.type == pafs.FileType.File]
                if files:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{folder}/{i.base_name}" for i in files], pa.string()),
                        pa.array([i.mtime.replace(tzinfo=None) if i.mtime is not None else None for i in files], pa.timestamp("us")),
                        pa.array([int(i.size) for i in files], pa.int64())], schema=SCHEMA)

    def commit(self, end: dict) -> None:
        pass


class MaildirSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "maildir"

    def schema(self) -> str:
        return "path string, mtime timestamp_ntz, size bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MaildirStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("maildir")`` known to a session."""
    spark.dataSource.register(MaildirSource)
