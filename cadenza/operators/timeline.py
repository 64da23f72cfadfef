"""Operators over the frames of clips in order: sampling, trimming, retiming, collapsing, timing.

A frame table has a clip key, an order (one or more columns that order a clip's frames without ties) and what
else the operator needs. Every operator but ``delays_in_turn`` is built-in expressions and windows partitioned by clip, so a plan
that chains several of them shuffles once. Times are seconds (double) or whole microseconds (long); functions
that are sensitive to rounding take microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Output ticks are hundredths of a second; a frame is shown for so many at least and at most.
TICK_US, LEAST_TICKS, MOST_TICKS = 10_000, 2, 30_000
#: A first frame that starts later than this is moved to 0 (microseconds).
FIRST_OFFSET_US = 10_000


def _in_order(clip: str, order: Sequence[str]):
    return Window.partitionBy(clip).orderBy(*order)


def numbered(frames: DataFrame, clip: str, order: Sequence[str], index: str = "i", count: str | None = None) -> DataFrame:
    """Frames with their number in the clip, from 0 without holes (also renumbers after a filter), and, if asked for,
    how many the clip has."""
    frames = frames.withColumn(index, F.row_number().over(_in_order(clip, order)) - 1)
    return frames.withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(clip))) if count else frames


def since_first(frames: DataFrame, clip: str, ts: str, out: str = "p") -> DataFrame:
    """Whole microseconds since the clip's first frame, from timestamps with or without time zone."""
    return frames.withColumn(out, F.timestamp_diff("MICROSECOND", F.min(ts).over(Window.partitionBy(clip)), F.col(ts)))


def sample_times(clips: DataFrame, duration: str = "duration", fps: str = "fps", start: str = "start", bounce: bool = False) -> DataFrame:
    """A row per requested time: k (from 0) and time = start + k / fps for k below trunc(duration * fps), and without
    bounce a last one at start + duration. Clips with fewer than two such frames give none (``too_short`` finds them)."""
    n = F.floor(F.col(duration) * F.col(fps)).cast("int")
    grid = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("k"), (F.col(start) + k / F.col(fps)).alias("time")))
    if not bounce:
        grid = F.concat(grid, F.array(F.struct(n.alias("k"), (F.col(start) + F.col(duration)).alias("time"))))
    return clips.filter(n >= 2).select("*", F.inline(grid))


def too_short(clips: DataFrame, duration: str = "duration", fps: str = "fps") -> DataFrame:
    """Clips that have fewer than two frames at their rate, or a null."""
    return clips.filter(~F.coalesce(F.floor(F.col(duration) * F.col(fps)) >= 2, F.lit(False)))


def trim(frames: DataFrame, pts: str, low: Column | float, high: Column | float) -> DataFrame:
    """Frames inside a closed range of time."""
    return frames.filter(F.col(pts).between(low, high))


def decimate(frames: DataFrame, source_fps: tuple[int, int], wanted_fps: tuple[int, int], index: str = "i") -> DataFrame:
    """Drop frames to come down to a wanted rate (rates are fractions); a higher wanted rate keeps all.

    The k-th kept frame is number max(k, ceil(k r) - 1), r the ratio of the rates. So frame i is kept if a multiple
    of r lies in (i, i + 1], which whole-number arithmetic decides for each row on its own; frame 0 always is.
    """
    up, down = source_fps[0] * wanted_fps[1], source_fps[1] * wanted_fps[0]  # r = up / down
    if up <= down:
        return frames
    return frames.filter(F.expr(f"{index} = 0 or ({index} + 1) * {down}L div {up}L > {index} * {down}L div {up}L"))


def retime(frames: DataFrame, pts: str, speed: Column | float) -> DataFrame:
    """Play ``speed`` times as fast."""
    return frames.withColumn(pts, F.col(pts) / speed)


def monotonic(frames: DataFrame, clip: str, order: Sequence[str], time: str) -> DataFrame:
    """Frames, in order of arrival, whose time is above that of all before (the first always)."""
    before = F.max(time).over(_in_order(clip, order).rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col(time) > F.col("__before"))).drop("__before")


def durations(frames: DataFrame, clip: str, order: Sequence[str], pts: str, least: float, duration: str = "duration", end: str = "end") -> DataFrame:
    """A frame's duration (the gap before it, ``least`` at least) and end (the next one's time, or its own plus duration)."""
    w = _in_order(clip, order)
    frames = frames.withColumn(duration, F.greatest(F.col(pts) - F.lag(pts, 1, 0).over(w), F.lit(least)))
    return frames.withColumn(end, F.coalesce(F.lead(pts).over(w), F.col(pts) + F.col(duration)))


def without_first_offset(frames: DataFrame, clip: str, order: Sequence[str], pts: str, threshold: float = FIRST_OFFSET_US) -> DataFrame:
    """Move clips that start later than ``threshold`` to 0; ``offset`` is what was taken off (else 0)."""
    first = F.first(pts).over(_in_order(clip, order))
    frames = frames.withColumn("offset", F.when(first > threshold, first).otherwise(F.lit(0).cast(frames.schema[pts].dataType)))
    return frames.withColumn(pts, F.col(pts) - F.col("offset"))


def bounce(frames: DataFrame, index: str = "i", count: str = "n", mode: str = "turn", out: str = "out_index") -> DataFrame:
    """Frames forward and then backward. ``turn``: 0..n-1, n-2..0 (2n - 1 frames); ``repeat``: the last frame twice,
    the first not again: 0..n-1, n-1..1. No shuffle: each frame places its own return."""
    i, n = F.col(index), F.col(count)
    back = {"turn": (2 * n - 2 - i, i < n - 1), "repeat": (2 * n - 1 - i, i > 0)}[mode]
    places = F.when(back[1], F.array(i.cast("long"), back[0].cast("long"))).otherwise(F.array(i.cast("long")))
    return frames.withColumn(out, F.explode(places))


def collapse_runs(frames: DataFrame, clip: str, order: Sequence[str], value: str, first_of: Sequence[str] = ()) -> DataFrame:
    """Of frames in a row with equal ``value`` (null equals null) the last; ``first_<c>`` is column c of the run's first."""
    w = _in_order(clip, order)
    frames = frames.withColumns({
        "__last": F.lead(F.lit(True)).over(w).isNull() | ~F.col(value).eqNullSafe(F.lead(value).over(w)),
        "__starts": F.lag(F.lit(True)).over(w).isNull() | ~F.col(value).eqNullSafe(F.lag(value).over(w)),
    })
    if first_of:
        frames = frames.withColumn("__run", F.sum(F.col("__starts").cast("long")).over(w))
        in_run = Window.partitionBy(clip, "__run").orderBy(*order)
        frames = frames.withColumns({f"first_{c}": F.first(c).over(in_run) for c in first_of}).drop("__run")
    return frames.filter("__last").drop("__last", "__starts")


def drop_unchanged(frames: DataFrame, clip: str, order: Sequence[str], changed: str, keeps: str) -> DataFrame:
    """Drop a frame without changes if the last frame that stayed leaves its picture on screen (``keeps``).

    A frame with changes always stays, and so do those after it up to and with the first that keeps; the rest
    until the next change goes. A clip's first frame stays. So the recursion is two windows.
    """
    w = _in_order(clip, order)
    lead_in = F.col(changed) | F.lag(F.lit(True)).over(w).isNull()
    frames = frames.withColumn("__group", F.sum(lead_in.cast("long")).over(w))
    before = F.max(F.col(keeps)).over(Window.partitionBy(clip, "__group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumn("__covered", F.coalesce(before, F.lit(False))).filter("not __covered").drop("__group", "__covered")


def disposal(frames: DataFrame, clip: str, order: Sequence[str], loses_alpha: str, first_transparent: str, out: str = "dispose") -> DataFrame:
    """``background`` where the next frame is more transparent somewhere (``loses_alpha`` of that frame), else ``keep``; a
    clip's last frame: background if its first frame had transparency."""
    w = _in_order(clip, order)
    first = F.first(first_transparent).over(w)
    clears = F.coalesce(F.lead(loses_alpha).over(w), first)
    return frames.withColumn(out, F.when(clears, "background").otherwise("keep"))


def delay_ticks(frames: DataFrame, clip: str, order: Sequence[str], end: str, out: str = "delay") -> DataFrame:
    """Display time in ticks: the rounded end less what was shown so far, LEAST_TICKS at least.

    ``end`` is the end in ticks (a whole number). Total so far is 2 i + max(0, running max of end_j - 2 j), i from
    1, so one window is enough. It ignores the upper limit; ``delays_in_turn`` has it.
    """
    w = _in_order(clip, order)
    i = F.row_number().over(w)
    frames = frames.withColumn("__slack", F.col(end) - LEAST_TICKS * i).withColumn("__i", i)
    total = LEAST_TICKS * F.col("__i") + F.greatest(F.lit(0), F.max("__slack").over(w))
    frames = frames.withColumn("__total", total)
    return frames.withColumn(out, F.col("__total") - F.lag("__total", 1, 0).over(w)).drop("__slack", "__i", "__total")


def delays_in_turn(frames: DataFrame, clip: str, order: Sequence[str], end: str, out: str = "delay", most: int = MOST_TICKS) -> DataFrame:
    """``frames`` with the display time of each, with both limits: what one frame can't show is carried on to the next.

    A clip's rows stream past in order; only the running total is held.
    """
    rows = frames.repartition(clip).sortWithinPartitions(clip, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = object(), 0
        for batch in batches:
            delays = []
            for own, ended in zip(batch.column(clip).to_pylist(), batch.column(end).to_pylist()):
                if own != last:
                    last, total = own, 0
                delays.append(min(max(ended - total, LEAST_TICKS), most))
                total += delays[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(delays, pa.int64())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, StructType([*frames.schema]).add(out, "long"))


def drop_leading_blank(samples: DataFrame, clip: str, order: Sequence[str], is_blank: Column) -> DataFrame:
    """Samples from the first that isn't blank on; a clip of blanks only disappears (``all_blank`` finds it)."""
    seen = F.max(~is_blank).over(_in_order(clip, order))
    return samples.withColumn("__seen", seen).filter("__seen").drop("__seen")


def all_blank(samples: DataFrame, clip: str, is_blank: Column) -> DataFrame:
    return samples.groupBy(clip).agg(F.bool_and(is_blank).alias("__all")).filter("__all").select(clip)


def frame_at(frames: DataFrame, times: DataFrame, clip: str, order: Sequence[str], pts: str, time: str, value: str, out: str = "found") -> DataFrame:
    """For each row of ``times`` the ``value`` of the clip's last frame at or before ``time`` (null before the first; of
    frames at one time the last in ``order``).

    Frames and times meet in one sorted union, not in a range join: work is linear in both, whatever the overlap.
    ``value`` must not be null in ``frames``.
    """
    left = frames.select(F.col(clip).alias("__clip"), F.col(pts).alias("__t"), F.lit(0).alias("__kind"), F.struct(*order).alias("__order"), F.col(value).alias("__value"), F.lit(None).cast(times.schema).alias("__row"))
    right = times.select(F.col(clip).alias("__clip"), F.col(time).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(left.schema["__order"].dataType).alias("__order"), F.lit(None).cast(left.schema["__value"].dataType).alias("__value"), F.struct(*times.columns).alias("__row"))
    w = Window.partitionBy("__clip").orderBy("__t", "__kind", "__order")
    found = left.unionByName(right).withColumn("__found", F.last("__value", ignorenulls=True).over(w))
    return found.filter("__kind = 1").select("__row.*", F.col("__found").alias(out))


def frame_index_at(time: Column, start: Column, fps: Column, count: Column, speed: Column | float = 1.0) -> Column:
    """The number of the frame shown at a time, for evenly spaced frames: floor((t speed - start) fps / speed), inside the clip."""
    return F.least(F.greatest(F.floor((time * speed - start) * fps / speed), F.lit(0)), count - 1)


def resample(frames: DataFrame, clips: DataFrame, clip: str, order: Sequence[str], pts: str, value: str, fps: float, speed: float = 1.0) -> DataFrame:
    """Frames on an even grid: the k-th output frame, at k / fps, shows what the clip shows at k speed / fps. ``clips``
    has each clip's ``duration``; frames are repeated or dropped as it takes."""
    n = F.ceil(F.col("duration") * fps / speed).cast("int")
    grid = clips.filter(n > 0).select(clip, F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    grid = grid.select(clip, "k", (F.col("k") * F.lit(speed / fps)).alias("__at"), (F.col("k") / F.lit(fps)).alias("pts_out"))
    return frame_at(frames, grid, clip, order, pts, "__at", value, value).drop("__at").withColumnRenamed("pts_out", pts)
