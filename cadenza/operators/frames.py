"""Pixel operators over tables of frames, one frame at a time.

A frame row has clip_id, frame_index, pts, width, height and ``rgba`` (binary, rows from the top). Kernels are
numpy and run inside Arrow batches; nothing is compared between rows, so there is no shuffle, and a frame is the
most that a task must hold beside its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.functions import pixels

FRAME = "clip_id string, frame_index long, pts double, width int, height int, rgba binary"


def image(width: int, height: int, rgba: bytes, channels: int = 4) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, channels)


def map_images(frames: DataFrame, change: Callable[[np.ndarray, dict], np.ndarray], needs: tuple[str, ...] = ()) -> DataFrame:
    """Replace every picture by ``change(picture, row)``; sizes follow. ``row`` has the columns ``needs``. A null picture stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            w, h, data = [], [], []
            for i in range(batch.num_rows):
                rgba = columns["rgba"][i].as_py()
                if rgba is None:
                    w.append(columns["width"][i].as_py())
                    h.append(columns["height"][i].as_py())
                    data.append(None)
                    continue
                out = change(image(columns["width"][i].as_py(), columns["height"][i].as_py(), rgba), {n: columns[n][i].as_py() for n in needs})
                h.append(out.shape[0])
                w.append(out.shape[1])
                data.append(np.ascontiguousarray(out).tobytes())
            columns |= {"width": pa.array(w, pa.int32()), "height": pa.array(h, pa.int32()), "rgba": pa.array(data, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return frames.mapInArrow(run, frames.schema)


def resized(frames: DataFrame) -> DataFrame:
    """Pictures at the size of the columns to_width and to_height."""
    return map_images(frames, lambda x, r: pixels.resize(x, r["to_width"], r["to_height"]), ("to_width", "to_height"))


def matted(frames: DataFrame, matte: tuple[int, int, int]) -> DataFrame:
    return map_images(frames, lambda x, _: pixels.over_matte(x, matte))


def solid_or_clear(frames: DataFrame) -> DataFrame:
    return map_images(frames, lambda x, _: pixels.solid_or_clear(x))


def cropped(frames: DataFrame) -> DataFrame:
    """The part at crop_x, crop_y, crop_width, crop_height (pixels); frames that don't hold it all are left out."""
    inside = (F.col("crop_x") >= 0) & (F.col("crop_y") >= 0) & (F.col("crop_width") >= 1) & (F.col("crop_height") >= 1)
    inside &= (F.col("crop_x") + F.col("crop_width") <= F.col("width")) & (F.col("crop_y") + F.col("crop_height") <= F.col("height"))
    return map_images(frames.filter(inside), lambda x, r: pixels.crop(x, r["crop_x"], r["crop_y"], r["crop_width"], r["crop_height"]), ("crop_x", "crop_y", "crop_width", "crop_height"))


def unpacked(raw: DataFrame) -> DataFrame:
    """Frames from raw rows: data (binary), layout (rgba, argb, bgra, abgr or rgb), stride (pixels; null: width) and, if
    there is such a column, premultiplied (whether colours hold their alpha; null: no)."""
    frames = raw.withColumn("rgba", F.col("data")).drop("data")
    if "premultiplied" not in frames.columns:
        frames = frames.withColumn("premultiplied", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("rgba", "width", "height", "layout", "stride", "premultiplied")))
            data = [None if d is None else pixels.unpack(d, w, h, layout, stride, bool(held)).tobytes() for d, w, h, layout, stride, held in rows]
            columns = {n: batch.column(n) for n in batch.schema.names} | {"rgba": pa.array(data, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return frames.mapInArrow(run, frames.schema).drop("layout", "stride", "premultiplied")


def with_blur(frames: DataFrame, median: bool = False) -> DataFrame:
    """``blur`` (binary, RGB): the picture smoothed over 3 x 3 pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("width", "height", "rgba")))
            out = [None if d is None else pixels.blur(image(w, h, d), median).tobytes() for w, h, d in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "blur"])

    return frames.mapInArrow(run, StructType([*frames.schema]).add("blur", "binary"))


def with_digest(frames: DataFrame) -> DataFrame:
    """``digest`` of size and pixels, by which equal pictures are found without carrying them through a shuffle."""
    return frames.withColumn("digest", F.sha2(F.concat(F.encode(F.concat_ws("x", "width", "height"), "utf-8"), F.col("rgba")), 256))


def digest(picture: np.ndarray) -> str:
    h, w = picture.shape[:2]
    return hashlib.sha256(f"{w}x{h}".encode() + picture.tobytes()).hexdigest()


def pixel_rows(frames: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """A row per pixel: clip_id, frame_index, x, y, r, g, b, a and what the columns ``more`` (binary, a byte a pixel) have
    for it (int). A null picture has none."""
    names = [*"xyrgba", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (w, h, rgba, *others) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("width", "height", "rgba", *more)))):
                if rgba is None:
                    continue
                at = pa.array(np.full(w * h, i), pa.int64())
                columns = [np.tile(np.arange(w), h), np.repeat(np.arange(h), w), *np.frombuffer(rgba, np.uint8).reshape(-1, 4).T, *(np.frombuffer(x, np.uint8) for x in others)]
                yield pa.RecordBatch.from_arrays([batch.column("clip_id").take(at), batch.column("frame_index").take(at), *(pa.array(c.astype(np.int32)) for c in columns)], names=["clip_id", "frame_index", *names])

    key = frames.select("clip_id", "frame_index", "width", "height", "rgba", *more)
    schema = key.select("clip_id", "frame_index").schema
    for c in names:
        schema = schema.add(c, "integer")
    return key.mapInArrow(run, schema)


def changed_boxes(frames: DataFrame) -> DataFrame:
    """left, top, box_width, box_height (int): where each frame differs from the one before it in its clip (one pixel if
    nowhere); a clip's first frame is left out. Other columns go. Numbers alone are put in order; pictures meet the one
    before by its number, so a long clip's pictures are spread over all tasks."""
    numbers = frames.select("clip_id", "frame_index").withColumn("__at", F.lag("frame_index").over(Window.partitionBy("clip_id").orderBy("frame_index"))).filter("__at is not null")
    earlier = frames.select("clip_id", F.col("frame_index").alias("__at"), F.col("rgba").alias("__before"))
    pairs = frames.select("clip_id", "frame_index", "width", "height", "rgba").join(numbers, ["clip_id", "frame_index"]).join(earlier, ["clip_id", "__at"])
    pairs = pairs.select("clip_id", "frame_index", "width", "height", "rgba", "__before")
    names = ["left", "top", "box_width", "box_height"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = [pixels.changed_box(image(w, h, a), image(w, h, b)) for w, h, b, a in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "rgba", "__before")))]
            columns = zip(*boxes) if boxes else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), batch.column("frame_index"), *(pa.array(c, pa.int32()) for c in columns)], names=["clip_id", "frame_index", *names])

    schema = frames.select("clip_id", "frame_index").schema
    for n in names:
        schema = schema.add(n, "integer")
    return pairs.mapInArrow(run, schema)
