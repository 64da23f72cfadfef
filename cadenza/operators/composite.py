"""What a clip shows, frame by frame, from the parts that its frames draw: as windows over pixels, not a fold over frames.

A pixel shows what its frame draws there, else the last thing that stayed there. What stays of a frame is what it draws if
it is kept; nothing, over its whole part, if it is cleared afterwards; and if the frame before is put back, what was
there. So each pixel's history is an order of its own, and all pixels of a clip are scanned side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What stands for no colour.
NOTHING = -1


def pixel_events(parts: DataFrame) -> DataFrame:
    """clip_id, frame_index, x, y, draws (int: r, g, b as one number; null: nothing drawn) and stays (the same, NOTHING where
    it is cleared, null where what was before stays), a row per frame and pixel of the screen. Parts: clip_id,
    frame_index, screen_width, screen_height, left, top, width, height, rgba, dispose (keep, background, previous);
    what lies outside of the screen isn't drawn."""
    names = ["screen_width", "screen_height", "left", "top", "width", "height", "rgba", "dispose"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (sw, sh, left, top, w, h, rgba, dispose) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                part = np.frombuffer(rgba, np.uint8).reshape(h, w, 4)[: max(sh - top, 0), : max(sw - left, 0)].astype(np.int64)
                own = np.s_[top : top + part.shape[0], left : left + part.shape[1]]
                colour = part[..., 0] << 16 | part[..., 1] << 8 | part[..., 2]
                draws, some = np.zeros((sh, sw), np.int64), np.zeros((sh, sw), bool)
                draws[own], some[own] = colour, part[..., 3] >= 128
                stays, kept = draws.copy(), some.copy()
                if dispose == "background":
                    stays[own], kept[own] = NOTHING, True
                elif dispose == "previous":
                    kept[:] = False
                at = pa.array(np.full(sw * sh, i), pa.int64())
                columns = [pa.array(np.tile(np.arange(sw), sh), pa.int32()), pa.array(np.repeat(np.arange(sh), sw), pa.int32())]
                columns += [pa.array(v.reshape(-1).astype(np.int32), mask=~m.reshape(-1)) for v, m in ((draws, some), (stays, kept))]
                yield pa.RecordBatch.from_arrays([batch.column("clip_id").take(at), batch.column("frame_index").take(at), *columns], names=["clip_id", "frame_index", "x", "y", "draws", "stays"])

    rows = parts.select("clip_id", "frame_index", *names)
    schema = rows.select("clip_id", "frame_index").schema
    for c in ("x", "y", "draws", "stays"):
        schema = schema.add(c, "integer")
    return rows.mapInArrow(run, schema)


def composited(parts: DataFrame) -> DataFrame:
    """clip_id, frame_index, x, y, r, g, b, a (int; a is 255, or all are 0) of what is on the screen at each frame."""
    before = Window.partitionBy("clip_id", "x", "y").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.coalesce("draws", F.last("stays", ignorenulls=True).over(before), F.lit(NOTHING))
    rows = pixel_events(parts).withColumn("__c", shown)
    part = lambda shift: F.when(F.col("__c") >= 0, F.shiftright("__c", shift).bitwiseAND(F.lit(255))).otherwise(0)
    return rows.select("clip_id", "frame_index", "x", "y", part(16).alias("r"), part(8).alias("g"), part(0).alias("b"), F.when(F.col("__c") >= 0, 255).otherwise(0).alias("a"))


def coloured(parts: DataFrame) -> DataFrame:
    """``rgba`` instead of ``indices`` of parts with ``palette`` and ``clear`` (an index, -1 for none)."""
    keep = [c for c in parts.columns if c not in ("indices", "palette", "clear")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for indices, palette, clear in zip(*(batch.column(c).to_pylist() for c in ("indices", "palette", "clear"))):
                index, table = np.frombuffer(indices, np.uint8).astype(np.int64), np.frombuffer(palette, np.uint8).reshape(-1, 3)
                solid = index != clear
                rgba = np.zeros((len(index), 4), np.uint8)
                rgba[solid, :3], rgba[solid, 3] = table[index[solid]], 255
                out.append(rgba.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "rgba"])

    return parts.mapInArrow(run, parts.select(*keep).schema.add("rgba", "binary"))
