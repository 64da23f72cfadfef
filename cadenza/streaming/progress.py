"""Progress and abort of jobs: rows are counted by Spark as they pass, and a job is ended by its tag."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Counts of streams' and tables' rows, by name. Streams report after each micro-batch, tables when they are done.

    ``told`` is called with a name and its rows so far whenever they change; what it returns as False aborts the jobs
    of ``tag``, if there is one.
    """

    def __init__(self, spark: SparkSession, told: Callable[[str, int], Any] | None = None, tag: str | None = None):
        self.spark, self.told, self.tag = spark, told, tag
        self.rows: dict[str, int] = {}
        self.lock = Lock()
        spark.streams.addListener(self)

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def watched(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, whose rows count for ``name``. For a table, call ``done`` after its action."""
        with self.lock:
            self.rows.setdefault(name, 0)
        if df.isStreaming:
            return df.observe(name, F.count(F.lit(1)).alias("rows"))
        seen = Observation(name)
        self._seen = getattr(self, "_seen", {}) | {name: seen}
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def done(self, name: str) -> int:
        """The rows of a watched table whose action has ended."""
        self._count(name, self._seen.pop(name).get["rows"])
        return self.rows[name]

    def _count(self, name: str, more: int) -> None:
        with self.lock:
            self.rows[name] = self.rows.get(name, 0) + more
            rows = self.rows[name]
        if self.told and self.told(name, rows) is False and self.tag:
            abort(self.spark, self.tag)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            if name in self.rows and row["rows"]:
                self._count(name, row["rows"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def tagged(spark: SparkSession, tag: str | None = None) -> Iterator[str]:
    """Jobs that this thread starts inside have a tag, by which ``abort`` ends them and no others."""
    tag = tag or f"job-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    try:
        yield tag
    finally:
        context.removeJobTag(tag)


def abort(spark: SparkSession, tag: str) -> None:
    """End the running jobs of a tag. Sinks then abort, too, and leave nothing."""
    spark.sparkContext.cancelJobsWithTag(tag)
