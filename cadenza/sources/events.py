"""An event stream for readers that must not fall behind: ``spark.readStream.format("newest_events")`` after ``register``.

Events are lines of JSON in files of a folder, in order of the files' names; files are written whole. An offset is a
number of events. Of those that came since the last micro-batch only the newest ``keep`` (100) are read; the first of
these tells how many older ones were dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .shared import file_system

#: Events that a reader who is behind still gets (fixed value).
KEEP = 100


@dataclass
class Slice(InputPartition):
    """``take`` lines of a file from line ``skip`` on; the first of all tells of ``dropped`` events."""

    path: str
    skip: int
    take: int
    dropped: int


class NewestReader(DataSourceStreamReader):
    def __init__(self, path: str, keep: int):
        self.path, self.keep = path, keep
        self.lines: dict[str, int] = {}  # of the files seen so far

    def _look(self) -> int:
        """Events so far; only new files are read."""
        fs, base = file_system(self.path)
        for f in sorted(fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)), key=lambda f: f.path):
            if f.type == pafs.FileType.File and f.path.endswith(".jsonl") and f.path not in self.lines:
                with fs.open_input_stream(f.path) as data:
                    n = 0
                    while part := data.read(1 << 20):
                        n += part.count(b"\n")
                self.lines[f.path] = n
        return sum(self.lines.values())

    def initialOffset(self) -> dict:
        return {"events": 0}

    def latestOffset(self) -> dict:
        return {"events": self._look()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        first, until = max(start["events"], end["events"] - self.keep), end["events"]
        if sum(self.lines.values()) < until:  # a reader that was started again
            self._look()
        dropped, at, found = first - start["events"], 0, []
        for path in sorted(self.lines):
            n = self.lines[path]
            a, b = max(first - at, 0), min(until - at, n)
            if a < b:
                found.append(Slice(path, a, b - a, dropped))
                dropped = 0
            at += n
        return found

    def read(self, part: Slice) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        with fs.open_input_stream(part.path) as data:
            rest, k, dropped = b"", 0, part.dropped
            while chunk := data.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    if part.skip <= k < part.skip + part.take:
                        event = json.loads(line)
                        yield event.get("request_id"), event.get("key"), json.dumps(event), dropped
                        dropped = 0
                    k += 1
                    if k == part.skip + part.take:
                        return


class NewestEvents(DataSource):
    """Options: path, keep."""

    @classmethod
    def name(cls) -> str:
        return "newest_events"

    def schema(self) -> str:
        return "request_id long, key string, event string, dropped long"

    def streamReader(self, schema) -> NewestReader:
        return NewestReader(self.options["path"], int(self.options.get("keep", KEEP)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NewestEvents)
