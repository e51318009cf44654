"""A log file of JSON lines as a stream: the last lines first, then what is appended.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").option("replay", 200).load("/var/log/app.jsonl")

The offset is a place in the file (identity, bytes), so a stopped query goes on at the line where it was, and a batch that is tried
again reads the same bytes. Lines are whole: one that is being written waits for its end. A file that is shorter than the
offset, or another file under the name, is read from its start, as ``tail -F`` does.

Lines become records by ``tables.parse_log``. The file has to be where the driver reads it: a tail is read by one reader.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quern.functions.text import lookup
from quern.sources.tables import parse_log

#: Lines that are replayed at first; bytes that one batch reads at most.
REPLAY, MOST = 200, 16 << 20
LEVELS = {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3, "CRITICAL": 4}


def start_of_last(path: str, lines: int, block: int = 1 << 16) -> int:
    """The place in the file where its last ``lines`` whole lines begin; the file is read from its end."""
    with open(path, "rb") as f:
        at, found = f.seek(0, os.SEEK_END), 0
        while at > 0:
            low = max(0, at - block)
            f.seek(low)
            data = f.read(at - low)
            for k in range(len(data) - 1, -1, -1):
                found += data[k] == 10
                # the first newline from the end closes the last whole line
                if found == lines + 1:
                    return low + k + 1
            at = low
    return 0


class LogTail(DataSource):
    """line string: the lines of one file."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "line string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TailReader(self.options["path"].removeprefix("file://"), int(self.options.get("replay", REPLAY)))


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, replay: int):
        self.path, self.replay = path, replay

    def _file(self) -> tuple[int, int]:
        try:
            s = os.stat(self.path)
            return s.st_ino, s.st_size
        except FileNotFoundError:
            return 0, 0

    def initialOffset(self) -> dict:
        ino, size = self._file()
        return {"file": ino, "at": start_of_last(self.path, self.replay) if size else 0}

    def _lines(self, low: int, high: int) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(low)
            data = f.read(high - low)
        return iter([(x.decode("utf-8", "replace"),) for x in data.split(b"\n")[:-1]])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        ino, size = self._file()
        at = start["at"] if ino == start["file"] and size >= start["at"] else 0
        if size <= at:
            return iter([]), {"file": ino, "at": at} if ino else start
        with open(self.path, "rb") as f:
            f.seek(at)
            data = f.read(min(size - at, MOST))
            # a line longer than a batch is read to its end
            while b"\n" not in data and at + len(data) < size:
                data += f.read(MOST)
        end = at + data.rfind(b"\n") + 1
        return self._lines(at, end), {"file": ino, "at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        low = start["at"] if start["file"] == end["file"] and start["at"] <= end["at"] else 0
        return self._lines(low, end["at"])


def at_least(level: Column, least: str) -> Column:
    """Whether a level is ``least`` or higher; unknown ones count as DEBUG, missing ones as INFO."""
    return F.coalesce(lookup(F.upper(F.coalesce(level, F.lit("INFO"))), LEVELS), F.lit(0)) >= LEVELS.get(least.upper(), 0)


def tail(spark: SparkSession, path: str, level: str = "", replay: int = REPLAY) -> DataFrame:
    """Records of the log as they come, of ``level`` or higher."""
    spark.dataSource.register(LogTail)
    rows = spark.readStream.format("log_tail").option("replay", replay).load(path)
    records = rows.where(F.trim("line") != "").select(parse_log(F.col("line"), F.lit(None).cast("string")).alias("r")).select("r.*")
    return records.where(at_least(F.col("level"), level)) if level else records
