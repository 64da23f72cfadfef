"""Live preview requests as a stream: stale ones go, bursts become one, the newest run wins.

A request has a key (who asks), a growing request id, a time ``ts`` (timestamp) and its settings.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds of quiet after which a burst counts as over, by what changed (fixed values).
QUIET = {"preview": 0.2, "speed": 0.4, "estimate": 0.5, "crop": 2.0}
#: Events that a reader who is behind still gets.
NEWEST = 100


def debounced(requests: DataFrame, key: str, quiet: float = QUIET["preview"], lateness: str = "1 second") -> DataFrame:
    """The last request of each burst, once nothing followed for ``quiet`` seconds. Streams emit a burst when the
    watermark (``lateness`` behind the newest time) has passed it."""
    own = [c for c in requests.columns if c != key]
    marked = requests.withWatermark("ts", lateness) if requests.isStreaming else requests
    bursts = marked.groupBy(key, F.session_window("ts", f"{round(quiet * 1e6)} microseconds").alias("burst"))
    return bursts.agg(F.max_by(F.struct(*own), F.struct("ts", "request_id")).alias("r"), F.count(F.lit(1)).alias("requests")).select(key, "r.*", "requests")


def without_stale(requests: DataFrame, key: str) -> DataFrame:
    """Of a stream, the requests whose id is at least as high as any that their key had before. The state is a number
    per key; within a micro-batch requests are taken in order of time."""

    def keep(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"], kind="stable")
        ids = rows["request_id"].tolist()
        good = []
        for i in ids:
            good.append(newest is None or i >= newest)
            newest = i if newest is None else max(newest, i)
        state.update((newest,))
        yield rows[good]

    return requests.groupBy(key).applyInPandasWithState(keep, requests.schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def newest_ids(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``without_stale`` over a finished table: the requests whose id is at least as high as any before of their key."""
    before = F.max("request_id").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return requests.withColumn("__before", before).filter("__before is null or request_id >= __before").drop("__before")


def joint_progress(parts: list[tuple[float, Column]]) -> Column:
    """``weighted_progress`` of columns."""
    total = sum(w for w, _ in parts)
    return sum((F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * w for w, p in parts), F.lit(0.0)) / total


def newest_events(batch: DataFrame, most: int = NEWEST) -> DataFrame:
    """Of a micro-batch the newest events, for a reader that must not fall behind (use in foreachBatch)."""
    return batch.orderBy(F.desc("ts"), F.desc("request_id")).limit(most)


@dataclass(frozen=True)
class Preview:
    """A finished preview: where it is stored, and for which settings and range of time."""

    settings: Any
    low: float
    high: float
    path: str


@dataclass
class PreviewStore:
    """Finished previews; one with equal settings whose range holds the wanted one is used again."""

    spark: SparkSession
    folder: str
    made: list[Preview] = field(default_factory=list)

    def find(self, settings: Any, low: float, high: float) -> Preview | None:
        return next((p for p in reversed(self.made) if p.settings == settings and p.low <= low and high <= p.high), None)

    def get(self, settings: Any, low: float, high: float, build: Callable[[], DataFrame], pts: str = "pts") -> DataFrame:
        """The preview's frames in the range, built and stored unless a finished one holds them."""
        found = self.find(settings, low, high)
        if found is None:
            path = f"{self.folder}/preview-{uuid.uuid4().hex}"
            build().write.parquet(path)
            found = Preview(settings, low, high, path)
            self.made.append(found)
        return self.spark.read.parquet(found.path).filter(F.col(pts).between(low, high))


class LatestWins:
    """Runs jobs one after another of which only the newest matters: a new one cancels what runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.lock, self.tag, self.number = spark, threading.Lock(), None, 0

    def run(self, job: Callable[[], Any]) -> Any:
        """The job's result; None if a newer job has started meanwhile (its Spark jobs are cancelled)."""
        with self.lock:
            if self.tag:
                self.spark.sparkContext.cancelJobGroup(self.tag)
            self.number += 1
            own, self.tag = self.number, f"latest-{uuid.uuid4().hex}"
            tag = self.tag
        context = self.spark.sparkContext
        context.setJobGroup(tag, "latest wins", interruptOnCancel=True)
        try:
            result = job()
        except Exception:
            if own != self.number:
                return None
            raise
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        return result if own == self.number else None


def weighted_progress(parts: list[tuple[float, float]]) -> float:
    """Progress 0..1 of tasks in a row, each (weight, its own progress)."""
    total = sum(w for w, _ in parts)
    return min(1.0, max(0.0, sum(w * min(1.0, max(0.0, p)) for w, p in parts) / total)) if total else 0.0
