"""Scans over clips of any length, in two levels.

``timeline``'s windows order a clip in one task. Here rows are put in order by ranges of (clip, order), so that a long
clip is many tasks' work, and cut into blocks. Each block is summed up in a few numbers (its largest value, its sum,
how it changes a running total); the summaries of a clip, one per ``BLOCK_ROWS`` rows, are scanned in order; and each
block is finished on its own with what comes before it. Results equal those of the functions of the same name there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from cadenza.sources import shared

from .timeline import LEAST_TICKS, MOST_TICKS

BLOCK_ROWS = 10_000
#: The columns that ``in_blocks`` adds.
POS, BLOCK = "__pos", "__block"
#: What an absent end counts as: a frame without one is shown for the least time.
NO_END = -(1 << 60)


def _keys(clip: str | Sequence[str]) -> list[str]:
    return [clip] if isinstance(clip, str) else [*clip]


def in_blocks(frames: DataFrame, clip: str | Sequence[str], order: Sequence[str | Column], rows: int = 0) -> DataFrame:
    """``frames``, stored, with __pos (long), which grows with (clip, order) over the whole table, and __block (long): at
    most ``rows`` (BLOCK_ROWS) rows that follow each other. ``clip`` may be several columns, or none."""
    by = [*_keys(clip), *order]
    at, mask = F.monotonically_increasing_id(), (1 << 33) - 1
    ranged = frames.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(POS, at)
    block = F.shiftleft(F.shiftright(POS, 33), 22) + F.floor(F.col(POS).bitwiseAND(F.lit(mask)) / (rows or BLOCK_ROWS)).cast("long")
    return shared.stored(ranged.withColumn(BLOCK, block), "blocks")


def running(blocks: DataFrame, clip: str | Sequence[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running values of ``in_blocks``' rows: out: (kind, value). Kinds, nulls being passed over: ``max`` and ``sum`` up
    to a row, ``max_before`` without the row itself, ``last`` (the last value up to the row), ``last_before``, and ``next``
    (the first value after the row). A sum of nothing is 0, anything else of nothing null."""
    keys = _keys(clip)
    own = {out: f"__v{k}" for k, out in enumerate(values)}
    blocks = blocks.withColumns({own[out]: v for out, (_, v) in values.items()})
    present = lambda c: F.when(F.col(c).isNotNull(), F.col(POS))
    whole = {"max": F.max, "sum": F.sum, "last": lambda c: F.max_by(c, present(c)), "next": lambda c: F.min_by(c, present(c))}
    scan = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True), "next": lambda c: F.first(c, ignorenulls=True)}
    name = lambda kind: kind.removesuffix("_before")
    summaries = blocks.groupBy(*keys, BLOCK).agg(*(whole[name(kind)](own[out]).alias(own[out]) for out, (kind, _) in values.items()))
    of_clip = Window.partitionBy(*keys).orderBy(BLOCK)
    before, after = of_clip.rowsBetween(Window.unboundedPreceding, -1), of_clip.rowsBetween(1, Window.unboundedFollowing)
    carried = summaries.select(*(F.col(k).alias(f"__by{i}") for i, k in enumerate(keys)), F.col(BLOCK).alias("__b"), *(scan[name(kind)](own[out]).over(after if kind == "next" else before).alias(f"__c{own[out]}") for out, (kind, _) in values.items()))
    same = F.col(BLOCK) == F.col("__b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__by{i}"))
    joined = blocks.join(carried, same)
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(POS)
    found = {}
    for out, (kind, _) in values.items():
        frame = (1, Window.unboundedFollowing) if kind == "next" else (Window.unboundedPreceding, -1 if kind.endswith("_before") else 0)
        local, carry = scan[name(kind)](own[out]).over(in_block.rowsBetween(*frame)), F.col(f"__c{own[out]}")
        found[out] = {"max": lambda: F.greatest(carry, local), "sum": lambda: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))}.get(name(kind), lambda: F.coalesce(local, carry))()
    return joined.withColumns(found).drop(*own.values(), *(f"__c{c}" for c in own.values()), "__b", *(f"__by{i}" for i in range(len(keys))))


def numbered(frames: DataFrame, clip: str | Sequence[str], order: Sequence[str | Column], index: str = "i") -> DataFrame:
    """Frames with their number in the clip, from 0 without holes."""
    found = running(in_blocks(frames, clip, order), clip, {index: ("sum", F.lit(1).cast("long"))})
    return found.withColumn(index, F.col(index) - 1).drop(POS, BLOCK)


def monotonic(frames: DataFrame, clip: str, order: Sequence[str], time: str) -> DataFrame:
    """Frames, in order of arrival, whose time is above that of all before (the first always)."""
    found = running(in_blocks(frames, clip, order), clip, {"__before": ("max_before", F.col(time))})
    return found.filter(F.col("__before").isNull() | (F.col(time) > F.col("__before"))).drop("__before", POS, BLOCK)


def written_bytes(frames: DataFrame, clip: str, order: Sequence[str], size: Column, out: str = "written") -> DataFrame:
    """Bytes written so far, with each frame's own."""
    return running(in_blocks(frames, clip, order), clip, {out: ("sum", size)}).drop(POS, BLOCK)


def drop_unchanged(frames: DataFrame, clip: str, order: Sequence[str], changed: str, keeps: str) -> DataFrame:
    """Drop a frame without changes if the last frame that stayed leaves its picture on screen (``keeps``).

    What a block does to the two states of the screen, covered or not, is told by its last change and the last frame that
    keeps: a frame goes if the latter, before it, isn't before the former, up to it.
    """
    blocks = running(in_blocks(frames, clip, order), clip, {"__seen": ("max_before", F.col(POS))})
    change = F.when(F.col(changed) | F.col("__seen").isNull(), F.col(POS))
    found = running(blocks, clip, {"__change": ("max", change), "__keep": ("max_before", F.when(F.col(keeps), F.col(POS)))})
    return found.filter(~F.coalesce(F.col("__keep") >= F.col("__change"), F.lit(False))).drop("__seen", "__change", "__keep", POS, BLOCK)


def collapse_runs(frames: DataFrame, clip: str, order: Sequence[str], value: str, first_of: Sequence[str] = ()) -> DataFrame:
    """Of frames in a row with equal ``value`` (null equals null) the last; ``first_<c>`` is column c of the run's first."""
    own = F.struct(F.col(value).alias("v"))
    blocks = running(in_blocks(frames, clip, order), clip, {"__before": ("last_before", own), "__after": ("next", own)})
    differs = lambda c: F.col(c).isNull() | ~F.col(value).eqNullSafe(F.col(f"{c}.v"))
    if first_of:
        starts = F.when(differs("__before"), F.struct(*first_of))
        blocks = running(blocks, clip, {"__first": ("last", starts)})
        blocks = blocks.withColumns({f"first_{c}": F.col(f"__first.{c}") for c in first_of}).drop("__first")
    return blocks.filter(differs("__after")).drop("__before", "__after", POS, BLOCK)


def frame_at(frames: DataFrame, times: DataFrame, clip: str, order: Sequence[str], pts: str, time: str, value: str, out: str = "found") -> DataFrame:
    """For each row of ``times`` the ``value`` of the clip's last frame at or before ``time`` (null before the first; of
    frames at one time the last in ``order``). ``value`` must not be null in ``frames``."""
    left = frames.select(F.col(clip).alias("__clip"), F.col(pts).alias("__t"), F.lit(0).alias("__kind"), F.struct(*order).alias("__order"), F.col(value).alias("__value"), F.lit(None).cast(times.schema).alias("__row"))
    right = times.select(F.col(clip).alias("__clip"), F.col(time).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(left.schema["__order"].dataType).alias("__order"), F.lit(None).cast(left.schema["__value"].dataType).alias("__value"), F.struct(*times.columns).alias("__row"))
    found = running(in_blocks(left.unionByName(right), "__clip", ["__t", "__kind", "__order"]), "__clip", {"__found": ("last", F.col("__value"))})
    return found.filter("__kind = 1").select("__row.*", F.col("__found").alias(out))


class Carry:
    """How a running total passes a block: a line of slope 1 with flat parts, by its corners; outside them the slope is 1."""

    def __init__(self, x: np.ndarray | Sequence[int] = (0,), y: np.ndarray | Sequence[int] = (0,)):
        self.x, self.y = np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)

    def then(self, end: int, least: int, most: int) -> None:
        """Let a frame follow that ends at ``end``: a total y becomes that, but y + least at least and y + most at most."""
        x, y = self.x, self.y
        for v in (end - most, end - least):
            at = int(np.searchsorted(y, v))
            if at < len(y) and y[at] == v:
                continue
            new = x[0] - (y[0] - v) if at == 0 else x[at - 1] + (v - y[at - 1])
            x, y = np.insert(x, at, new), np.insert(y, at, v)
        y = np.minimum(np.maximum(end, y + least), y + most)
        flat = np.diff(y) == 0
        corner = np.concatenate([[False], flat]) != np.concatenate([flat, [False]])
        if not corner.any():
            corner[0] = True
        self.x, self.y = x[corner], y[corner]

    def __call__(self, total: int) -> int:
        at = int(np.searchsorted(self.x, total))
        if at == 0:
            return int(self.y[0] - (self.x[0] - total))
        gone = total - self.x[at - 1]
        return int(self.y[at - 1] + (gone if at == len(self.x) else min(gone, self.y[at] - self.y[at - 1])))


def limited_delays(frames: DataFrame, clip: str, order: Sequence[str], end: str, out: str = "delay", least: int = LEAST_TICKS, most: int = MOST_TICKS) -> DataFrame:
    """``frames`` with the display time (long) of each: its ``end`` less what was shown so far, within both limits; what
    one frame can't show is carried on to the next (as ``timeline.delays_in_turn``). A null end: the least time."""
    blocks = in_blocks(frames.withColumn("__end", F.coalesce(F.col(end).cast("long"), F.lit(NO_END))), clip, order)
    key, names = frames.select(clip).schema, frames.columns

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, carry, done = None, None, []

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([p[0] for p, _ in done], kind), pa.array([p[1] for p, _ in done], pa.int64())]
            columns += [pa.array([v.tolist() for v in c], pa.list_(pa.int64())) for c in ([c.x for _, c in done], [c.y for _, c in done])]
            return pa.RecordBatch.from_arrays(columns, names=[clip, BLOCK, "x", "y"])

        for batch in batches:
            kind = batch.column(clip).type
            for own, block, ended in zip(*(batch.column(c).to_pylist() for c in (clip, BLOCK, "__end"))):
                if (own, block) != place or carry is None:
                    place, carry = (own, block), Carry()
                    done.append((place, carry))
                carry.then(ended, least, most)
            if len(done) > 1:
                last = done.pop()
                yield batch_of(kind)
                done = [last]
        if done:
            yield batch_of(kind)

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = object(), 0
        for batch in batches:
            before = []
            for own, x, y in zip(*(batch.column(c).to_pylist() for c in (clip, "x", "y"))):
                if own != last:
                    last, total = own, 0
                before.append(total)
                total = Carry(x, y)(total)
            yield pa.RecordBatch.from_arrays([batch.column(clip), batch.column(BLOCK), pa.array(before, pa.int64())], names=["__clip", "__b", "__before"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, 0
        for batch in batches:
            delays = []
            for own, block, ended, before in zip(*(batch.column(c).to_pylist() for c in (clip, BLOCK, "__end", "__before"))):
                if (own, block) != place:
                    place, total = (own, block), before
                delays.append(min(max(ended - total, least), most))
                total += delays[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(delays, pa.int64())], names=[*names, out])

    in_turn = lambda df: df.repartition(clip, BLOCK).sortWithinPartitions(clip, BLOCK, POS)
    sums = in_turn(blocks.select(clip, BLOCK, POS, "__end")).mapInArrow(sum_up, StructType([*key]).add(BLOCK, "long").add("x", ArrayType(LongType())).add("y", ArrayType(LongType())))
    passed = sums.repartition(clip).sortWithinPartitions(clip, BLOCK).mapInArrow(pass_on, StructType([StructField("__clip", key[0].dataType)]).add("__b", "long").add("__before", "long"))
    rows = blocks.join(passed, (F.col(BLOCK) == F.col("__b")) & F.col(clip).eqNullSafe(F.col("__clip"))).drop("__b", "__clip")
    return in_turn(rows).mapInArrow(finish, StructType([*frames.schema]).add(out, "long"))
