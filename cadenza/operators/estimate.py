"""Statistics and estimates over clips."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sampling import even_chunks


def clip_metadata(frames: DataFrame, clip: str, pts: str, width: str, height: str, size: Column) -> DataFrame:
    """A row per clip: frames, first and last time, largest sides, bytes and frames a second, in one aggregation."""
    stats = frames.groupBy(clip).agg(F.count(F.lit(1)).alias("frames"), F.min(pts).alias("first"), F.max(pts).alias("last"), F.max(width).alias("width"), F.max(height).alias("height"), F.sum(size).alias("bytes"))
    return stats.withColumn("fps", (F.col("frames") - 1) / F.nullif(F.col("last") - F.col("first"), F.lit(0)))


def keyframe_stats(samples: DataFrame, clip: str, is_key: Column) -> DataFrame:
    """Per clip: samples, keyframes, samples per keyframe (interval) and keyframes per sample (rate)."""
    stats = samples.groupBy(clip).agg(F.count(F.lit(1)).alias("samples"), F.sum(is_key.cast("long")).alias("keyframes"))
    return stats.select("*", (F.col("samples") / F.nullif("keyframes", F.lit(0))).alias("interval"), (F.col("keyframes") / F.col("samples")).alias("rate"))


def estimated_size(frames: DataFrame, clip: str, size: str, index: str = "i", count: str = "n", chunks: int = 5, length: int = 5, margin: float = 1.1) -> DataFrame:
    """Per clip, from the sizes of ``chunks`` chunks of ``length`` frames: their sum, scaled to all frames, with a margin."""
    sample = even_chunks(frames, chunks, length, index, count)
    sums = sample.groupBy(clip).agg(F.sum(size).alias("sampled_size"), F.count(F.lit(1)).alias("sampled"), F.first(count).alias("frames"))
    return sums.withColumn("estimate", F.col("sampled_size") * (F.col("frames") / F.col("sampled")) * margin)


def running_estimates(progress: DataFrame, clip: str, order: list[str], written: str, frames: str, total: str) -> DataFrame:
    """``estimate`` and ``shown`` (long) of each progress row, in order within its clip.

    Bytes so far (``written``), scaled from the ``frames`` done to the ``total``: an estimate rises at once and falls by
    halves. It starts beyond a warm-up of a sixteenth of the total (5 to 50 frames; unknown total: 10) and is 0 before;
    what is shown follows only when it is off by more than a tenth. A clip's rows stream past; two numbers are held.
    """
    rows = progress.repartition(clip).sortWithinPartitions(clip, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, estimate, shown = object(), 0, 0
        for batch in batches:
            estimates, displays = [], []
            for own, size, done, count in zip(*(batch.column(c).to_pylist() for c in (clip, written, frames, total))):
                if own != last:
                    last, estimate, shown = own, 0, 0
                if done > (10 if count is None else min(max(count // 16, 5), 50)):
                    whole = size * (max(done + 50, 100) if count is None else count) // done
                    estimate = whole if whole >= estimate else (estimate + whole) // 2
                    if abs(shown - estimate) > estimate // 10:
                        shown = estimate
                estimates.append(estimate)
                displays.append(shown)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(estimates, pa.int64()), pa.array(displays, pa.int64())], names=[*batch.schema.names, "estimate", "shown"])

    return rows.mapInArrow(run, StructType([*progress.schema]).add("estimate", "long").add("shown", "long"))


def naive_size(width: Column, height: Column, frames: Column, quality: Column) -> Column:
    """Bytes by size, frames and quality (0..1) alone."""
    return width * height * frames / 3 * (quality + 1.5) / 2.5


def output_duration(low: Column, high: Column, full: Column, bounces: Column) -> Column:
    """Seconds: of the range, or of the whole clip; twice that if it bounces."""
    return F.coalesce(high - low, full) * F.when(bounces, 2.0).otherwise(1.0)


def output_frames(duration: Column, fps: Column) -> Column:
    return F.floor(duration * fps)


def written_bytes(parts: DataFrame, clip: str, order: str, size: Column, out: str = "written") -> DataFrame:
    """Bytes written up to and with each part."""
    return parts.withColumn(out, F.sum(size).over(Window.partitionBy(clip).orderBy(order)))


def progress(done: Column, total: Column) -> Column:
    return F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0))


def remaining_seconds(elapsed: Column, done: Column) -> Column:
    """Seconds left at a share done; null while that says little (3 s are not over, 1 s is left, or all takes under 10 s)."""
    left = elapsed / done * (1 - done)
    return F.when((elapsed > 3) & (left > 1) & (elapsed + left > 10), left)


def first_track(tracks: DataFrame, clip: str, number: str, keep: Column | None = None) -> DataFrame:
    """A row per clip: its track of the least number (of those to ``keep``), with all columns."""
    rows = tracks if keep is None else tracks.filter(keep)
    own = [c for c in rows.columns if c != clip]
    return rows.groupBy(clip).agg(F.min_by(F.struct(*own), number).alias("t")).select(clip, "t.*")


def last_by_key(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """A row per key with its last value in an order."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
