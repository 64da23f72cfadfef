"""Live requests through one stateful operator: stale ids are refused, a burst becomes its last request, quiet keys cost nothing.

State is kept with timers in event time. A key's state is what its running burst needs: its highest id, its last request
and how many there were. When the watermark passes the quiet time after it, the request is given and the state is
deleted. What comes later than the watermark is refused by Spark itself, so an overtaken request stays refused.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .live import QUIET, newest_ids


class BurstProcessor(StatefulProcessor):
    """One key's requests."""

    def __init__(self, columns: list[str], quiet: float):
        self.columns, self.quiet = columns, pd.Timedelta(seconds=quiet)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("burst", "newest long, requests long, last binary")

    def _row(self, last: tuple, requests: int) -> tuple:
        return (*last, requests)

    def _given(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[*self.columns, "requests"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        newest, requests, last = (found[0], found[1], pickle.loads(bytes(found[2]))) if found else (None, 0, None)
        at = self.columns.index("ts")
        given = []
        for row in pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")[self.columns].itertuples(index=False, name=None):
            i = row[self.columns.index("request_id")]
            if last is not None and row[at] - last[at] > self.quiet:  # the burst was over before the watermark said so
                given.append(self._row(last, requests))
                newest, requests, last = None, 0, None
            if newest is not None and i < newest:
                continue
            newest, requests, last = i, requests + 1, row
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((int(newest), requests, pickle.dumps(last)))
        self.handle.registerTimer(int((last[at] + self.quiet).timestamp() * 1000) + 1)
        yield from self._given(given)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        self.state.clear()
        if found:
            yield from self._given([self._row(pickle.loads(bytes(found[2])), found[1])])


def settled(requests: DataFrame, key: str, quiet: float = QUIET["preview"], lateness: str = "1 second") -> DataFrame:
    """The last request of each burst that isn't stale, and how many of its burst weren't (``requests``).

    A request (``key``, request_id, ts, anything else) is stale if its burst had a higher id before, in order of ts and
    id. A burst ends when nothing that isn't stale follows for ``quiet`` seconds; streams give it when the watermark
    (``lateness`` behind the newest time) has passed that. A stream needs the RocksDB state store; a key that is quiet
    has no state. On a table the same by windows.
    """
    if requests.isStreaming:
        stream = requests.withWatermark("ts", lateness)
        schema = StructType([*requests.schema]).add("requests", "long")
        return stream.groupBy(key).transformWithStateInPandas(BurstProcessor(requests.columns, quiet), schema, "append", "eventTime")
    order = ["ts", "request_id"]
    w = Window.partitionBy(key).orderBy(*order)
    apart = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) > F.lit(round(quiet * 1e6))
    rows = requests.withColumn("__burst", F.sum(F.coalesce(apart, F.lit(True)).cast("long")).over(w))
    rows = rows.withColumn("__key", F.struct(key, "__burst"))
    fresh = newest_ids(rows, "__key", order)
    last = fresh.groupBy("__key").agg(F.max_by(F.struct(*requests.columns), F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("requests"))
    return last.select("r.*", "requests")
