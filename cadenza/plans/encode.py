"""From frames to GIF files: all stages as one plan."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.operators import frames as fr
from cadenza.operators import palette, smooth, timeline
from cadenza.sources import gif


def with_solid(frames: DataFrame) -> DataFrame:
    """``solid`` (binary, a bit per pixel): where a picture isn't clear; and ``any_clear``, ``changed`` (some pixel is important)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solid = [np.frombuffer(x, np.uint8)[3::4] >= 128 for x in batch.column("rgba").to_pylist()]
            bits = pa.array([np.packbits(x).tobytes() for x in solid], pa.binary())
            clear = pa.array([not x.all() for x in solid], pa.bool_())
            changed = pa.array([x is None or any(x) for x in batch.column("importance").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, bits, clear, changed], names=[*batch.schema.names, "solid", "any_clear", "changed"])

    return frames.mapInArrow(run, StructType([*frames.schema]).add("solid", "binary").add("any_clear", "boolean").add("changed", "boolean"))


def with_loss(frames: DataFrame) -> DataFrame:
    """``loses``: whether a pixel that is set in ``before`` (null: none) isn't in ``solid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("before").to_pylist(), batch.column("solid").to_pylist())
            lost = [a is not None and bool((np.frombuffer(a, np.uint8) & ~np.frombuffer(b, np.uint8)).any()) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lost, pa.bool_())], names=[*batch.schema.names, "loses"])

    return frames.mapInArrow(run, StructType([*frames.schema]).add("loses", "boolean"))


def disposed(kept: DataFrame) -> DataFrame:
    """``dispose`` of each frame, without those that change nothing on a picture that stays (a frame that clears stays).

    Only a bit per pixel goes through the windows.
    """
    order = ["frame_index"]
    marks = with_solid(kept.select("clip_id", "frame_index", "rgba", "importance")).drop("rgba", "importance")
    marks = with_loss(marks.withColumn("before", F.lag("solid").over(Window.partitionBy("clip_id").orderBy(*order)))).drop("before", "solid")
    marks = timeline.disposal(marks, "clip_id", order, "loses", "any_clear").withColumn("keeps", F.col("dispose") == "keep")
    marks = timeline.drop_unchanged(marks.withColumn("changed", F.col("changed") | ~F.col("keeps")), "clip_id", order, "changed", "keeps")
    return kept.join(marks.select("clip_id", "frame_index", "dispose"), ["clip_id", "frame_index"])


def lossy_level(quality: int) -> int:
    """How much loss the compressor may take (as ``rules.lossy_level``)."""
    return int((math.ceil(max(20 - quality / 5, 0) ** 1.8) + 10) * 10) if quality < 100 else 0


def encode_clips(frames: DataFrame, quality: int = 100, fast: bool = False, repeat: int | None = 0, colours: int | None = None, fixed: tuple[tuple[int, int, int], ...] = (), loss: int | None = None, lossy_quality: int | None = None, folder: str | None = None, extra: bool = False) -> DataFrame:
    """A GIF per clip (clip_id, frames, gif) of frames (clip_id, frame_index, pts, width, height, rgba); with a ``folder``
    files there instead (see ``gif.write_files``).

    ``lossy_quality`` (None: as ``quality``) gives the dithering and, unless ``loss`` is given, the loss. Alpha is made solid or clear, pixels are smoothed in time, equal pictures in a row become one (shown for the
    time of all), each frame gets its palette (with ``extra`` effort built again for a power of two), only what changes is drawn
    (after what turns clear is cleared), and display times are ticks, those beyond one frame's limit carried on. Clustering
    and compression run frame by frame; only smoothing (by tile) and drawing (by clip) follow time.
    """
    order = ["frame_index"]
    solid = fr.solid_or_clear(frames)
    even = smooth.smoothed(fr.with_blur(solid), quality)
    kept = timeline.collapse_runs(fr.with_digest(even), "clip_id", order, "digest", first_of=["importance"])
    kept = kept.withColumn("importance", F.col("first_importance")).drop("first_importance", "digest")
    kept = disposed(kept)
    times = timeline.without_first_offset(frames.select("clip_id", "frame_index", "pts"), "clip_id", order, "pts", threshold=0.01)
    times = timeline.durations(times, "clip_id", order, "pts", least=0.01)
    # a first frame that starts late gives the last one its offset as duration
    last = F.col("frame_index") == F.max("frame_index").over(Window.partitionBy("clip_id"))
    end = F.when(last & (F.col("offset") > 0), F.col("pts") + F.col("offset")).otherwise(F.col("end"))
    ends = times.withColumn("end_ticks", F.round(100 * end).cast("long")).select("clip_id", "frame_index", "end_ticks")
    timed = timeline.delays_in_turn(kept.select("clip_id", "frame_index").join(ends, ["clip_id", "frame_index"]), "clip_id", order, "end_ticks")
    timed = timed.select("clip_id", "frame_index", "delay")
    size = colours or (256 if quality >= 50 else min(256, 1 << (max(2 * quality, 5 + len(fixed)) - 1).bit_length()))
    lossy_quality = quality if lossy_quality is None else lossy_quality
    drawn = palette.assemble(palette.with_palette(palette.weighed(kept), min(size, 255), fixed, extra), quality, fast, palette.dither_level(quality, lossy_quality))
    blocks = gif.compressed(drawn, lossy_level(lossy_quality) if loss is None else loss).join(timed, ["clip_id", "frame_index"])
    return gif.write_files(blocks, folder, repeat) if folder else gif.files(blocks, repeat)
