"""Palettes, colour assignment, changed areas and the running picture of a clip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from cadenza.functions import pixels

MOST_COLOURS = 256


def build_palette(colours: np.ndarray, weights: np.ndarray, size: int, fixed: np.ndarray | None = None, rounds: int = 4) -> np.ndarray:
    """At most ``size`` colours (n, 3) for weighted colours: boxes cut at the weighted median of their widest channel,
    then moved to the means of what is nearest to them. ``fixed`` colours come first and stay."""
    fixed = np.empty((0, 3), np.uint8) if fixed is None else np.asarray(fixed, np.uint8).reshape(-1, 3)[:size]
    room = size - len(fixed)
    used = weights > 0
    colours, weights = colours[used], weights[used].astype(np.float64)
    if not len(colours) or room <= 0:
        return fixed
    codes = colours.astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])
    codes, at = np.unique(codes, return_inverse=True)
    weights = np.bincount(at, weights=weights)
    points = np.stack([codes >> 16, codes >> 8 & 255, codes & 255], axis=1).astype(np.float64)
    if len(points) <= room:
        return np.concatenate([fixed, points.astype(np.uint8)])
    scale = np.sqrt([2.0, 3.0, 1.0])
    boxes = [np.arange(len(points))]
    while len(boxes) < room:
        spread = [np.ptp(points[b] * scale, axis=0).max() * np.sqrt(weights[b].sum()) if len(b) > 1 else -1.0 for b in boxes]
        k = int(np.argmax(spread))
        if spread[k] <= 0:
            break
        own = boxes.pop(k)
        axis = int(np.argmax(np.ptp(points[own] * scale, axis=0)))
        own = own[np.argsort(points[own, axis], kind="stable")]
        run = np.cumsum(weights[own])
        cut = min(max(1, int(np.searchsorted(run, run[-1] / 2)) + 1), len(own) - 1)
        boxes += [own[:cut], own[cut:]]
    centres = np.stack([np.average(points[b], axis=0, weights=weights[b]) for b in boxes])
    every = np.concatenate([fixed.astype(np.float64), centres])
    for _ in range(rounds):
        near = nearest(points, every)
        mass = np.bincount(near, weights=weights, minlength=len(every))
        for c in range(3):
            mean = np.bincount(near, weights=weights * points[:, c], minlength=len(every))
            every[len(fixed) :, c] = np.where(mass > 0, mean / np.maximum(mass, 1e-12), every[:, c])[len(fixed) :]
    return np.clip(np.round(every), 0, 255).astype(np.uint8)


def nearest(points: np.ndarray, palette: np.ndarray, at_once: int = 16_384) -> np.ndarray:
    """Index of each point's nearest palette colour (the first of equals)."""
    scale = np.sqrt([2.0, 3.0, 1.0])
    p, q = points.astype(np.float64) * scale, palette.astype(np.float64) * scale
    out = np.empty(len(p), dtype=np.int64)
    for a in range(0, len(p), at_once):
        d = ((p[a : a + at_once, None, :] - q[None]) ** 2).sum(axis=2)
        out[a : a + at_once] = d.argmin(axis=1)
    return out


def second_pass_size(found: int) -> int | None:
    """With extra effort a palette that is small, or nearly full, is built again for this power of two of colours."""
    return 1 << max(1, (found - 1).bit_length()) if found < 128 or found > 220 else None


def merge_clear(indices: np.ndarray, palette: np.ndarray, alpha: np.ndarray, cut: int = 128) -> tuple[np.ndarray, np.ndarray, int]:
    """All palette entries whose alpha is at most ``cut`` made one, the last: (indices, solid colours, clear index or -1)."""
    solid = alpha > cut
    if solid.all():
        return indices, palette, -1
    to = np.where(solid, np.cumsum(solid) - 1, int(solid.sum()))
    return to[indices], palette[solid], int(solid.sum())


def masks_unchanged(keeps: bool, fast: bool, quality: int, index: int) -> bool:
    """Whether a frame's unimportant pixels are left to the frame before."""
    return keeps and (fast or (quality < 100 and index % 5 >= max(quality - 80, 0) // 4))


def weighed(frames: DataFrame) -> DataFrame:
    """``importance`` only where it holds: of a clip's first frame and of those before which the frame's picture stays
    (``dispose`` keep). After a frame that was cleared what is to be filled isn't known to it: null, so all pixels weigh
    alike. Only keys and disposals go through the window."""
    before = F.lag("dispose").over(Window.partitionBy("clip_id").orderBy("frame_index"))
    marks = frames.select("clip_id", "frame_index", (before.isNull() | (before == "keep")).alias("__holds"))
    rows = frames.join(marks, ["clip_id", "frame_index"])
    return rows.withColumn("importance", F.when(F.col("__holds"), F.col("importance"))).select(*frames.columns)


def with_palette(frames: DataFrame, colours: int = MOST_COLOURS, fixed: tuple[tuple[int, int, int], ...] = (), extra: bool = False) -> DataFrame:
    """``palette`` (binary, RGB triples) of every frame on its own; pixels weigh as much as the byte in ``importance`` (a
    null one: all alike; see ``weighed``). Clear pixels take no colour. With ``extra`` effort a palette of few or nearly all
    colours is built again for the power of two that a file stores anyway."""
    keep = np.array(fixed, np.uint8).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rgba, importance in zip(batch.column("rgba").to_pylist(), batch.column("importance").to_pylist()):
                x = np.frombuffer(rgba, np.uint8).reshape(-1, 4)
                w = np.ones(len(x)) if importance is None else np.frombuffer(importance, np.uint8)
                weights = np.where(x[:, 3] >= 128, w, 0)
                found = build_palette(x[:, :3], weights, colours, keep)
                again = second_pass_size(len(found)) if extra and len(found) else None
                if again and again != len(found):
                    found = build_palette(x[:, :3], weights, min(again, MOST_COLOURS), keep)
                out.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "palette"])

    return frames.mapInArrow(run, StructType([*frames.schema]).add("palette", "binary"))


def dither_level(quality: int, lossy_quality: int) -> float:
    """How far pixels are mixed of two colours, 0.2 to 1."""
    return max(0.2, min(1.0, quality * (0.25 + lossy_quality * 0.75 / 90) / 50 - 1))


def dithered(rgba: np.ndarray, palette: np.ndarray, index: np.ndarray, level: float) -> np.ndarray:
    """Indices in which pixels between two colours of the palette take the farther one as often as they lean to it, by an
    8 x 8 ordered pattern; a pixel whose colour is in the palette keeps it."""
    h, w = rgba.shape[:2]
    own = rgba.reshape(-1, 4)[:, :3].astype(np.float64)
    near = palette[index].astype(np.float64)
    off = pixels.distance(own, near)
    at = np.flatnonzero(off)
    if not len(at) or len(palette) < 2:
        return index
    second = nearest(np.clip(2 * own[at] - near[at], 0, 255), palette)
    first_gap, second_gap = np.sqrt(off[at]), np.sqrt(pixels.distance(own[at], palette[second].astype(np.float64)))
    share = level * first_gap / np.maximum(first_gap + second_gap, 1e-9)
    pattern = np.tile((pixels.ordered_matrix(3) + 0.5) / 64, (h // 8 + 1, w // 8 + 1))[:h, :w].reshape(-1)
    takes = share > pattern[at]
    out = index.copy()
    out[at[takes]] = second[takes]
    return out


def remap(rgba: np.ndarray, palette: np.ndarray, screen: np.ndarray | None, see_through: np.ndarray, level: float = 0.0) -> tuple[np.ndarray, int]:
    """Indices of a picture's pixels and which of them is clear (-1: none), mixed of two colours up to a ``level``.

    A pixel is clear where it has no colour, where ``see_through`` says so, or where what is on ``screen`` is at
    least as near to it as the palette.
    """
    flat = rgba.reshape(-1, 4)
    index = nearest(flat[:, :3], palette) if len(palette) else np.zeros(len(flat), np.int64)
    clear = (flat[:, 3] < 128) | see_through.reshape(-1)
    if screen is not None and len(palette):
        under = screen.reshape(-1, 4)
        clear |= (under[:, 3] >= 128) & (pixels.distance(under, flat) <= pixels.distance(palette[index], flat))
    if level and len(palette):
        index = dithered(rgba, palette, index, level)
    if clear.any() or not len(palette):
        index = np.where(clear, len(palette), index)
        return index.reshape(rgba.shape[:2]), len(palette)
    return index.reshape(rgba.shape[:2]), -1


def paint(screen: np.ndarray, index: np.ndarray, palette: np.ndarray, clear: int, left: int, top: int) -> np.ndarray:
    """The screen after a part is put on it."""
    out = screen.copy()
    part = out[top : top + index.shape[0], left : left + index.shape[1]]
    own = index != clear
    part[own, :3] = palette[np.minimum(index[own], len(palette) - 1)]
    part[own, 3] = 255
    return out


OUT_FRAME = "frame_index long, left int, top int, width int, height int, indices binary, palette binary, clear int, dispose string, screen_width int, screen_height int"


def assemble(frames: DataFrame, quality: int = 100, fast: bool = False, level: float = 0.0) -> DataFrame:
    """The parts to draw, clip by clip: each frame's pixels that change, as indices into its palette.

    Needs clip_id, frame_index, width, height, rgba, importance, palette, dispose (background or keep). What a frame
    draws depends on what the ones before it left on screen, so a clip is one ordered fold (palettes and
    compression are not part of it); its rows stream past, and the screen and one frame are held. The first and last
    frame are drawn whole, and so is one that is cleared after it: only what was drawn is cleared, and a pixel that
    turns clear may lie outside of what changed. ``level``: see ``remap``.
    """
    needed = frames.select("clip_id", F.col("frame_index").cast("long").alias("frame_index"), "width", "height", "rgba", "importance", "palette", "dispose")
    rows = needed.repartition("clip_id").sortWithinPartitions("clip_id", "frame_index")
    schema = needed.select("clip_id").schema
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in OUT_FRAME.split(", ")]
    for name, kind in fields:
        schema = schema.add(name, {"int": "integer"}.get(kind, kind))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, dict | None]]:
        """Each row with the one after it; none at the end."""
        before = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if before is not None:
                    yield before, row
                before = row
        if before is not None:
            yield before, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k, screen, keeps = object(), 0, None, False
        for r, following in stream(batches):
            w, h = r["width"], r["height"]
            if r["clip_id"] != own:
                own, k, screen, keeps = r["clip_id"], 0, np.zeros((h, w, 4), np.uint8), False
            rgba = np.frombuffer(r["rgba"], np.uint8).reshape(h, w, 4)
            palette = np.frombuffer(r["palette"], np.uint8).reshape(-1, 3)[: MOST_COLOURS - 1 if k else MOST_COLOURS]
            weight = np.frombuffer(r["importance"], np.uint8).reshape(h, w) if r["importance"] is not None else np.ones((h, w), np.uint8)
            lax = (weight == 0) & masks_unchanged(keeps, fast, quality, k)
            index, clear = remap(rgba, palette, screen if k else None, lax & (screen[..., 3] >= 128), level)
            after = paint(screen, index, palette, clear, 0, 0)
            last = following is None or following["clip_id"] != own
            left, top, pw, ph = (0, 0, w, h) if not k or last or r["dispose"] != "keep" else pixels.changed_box(screen, after)
            part = index[top : top + ph, left : left + pw]
            out = (r["frame_index"], left, top, pw, ph, part.astype(np.uint8).tobytes(), palette.tobytes(), clear, r["dispose"], w, h)
            names = ["clip_id", *(n for n, _ in fields)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, (own, *out)))], schema=pa.schema([("clip_id", clip_kind), *((n, kinds[t]) for n, t in fields)]))
            keeps = r["dispose"] == "keep"
            if keeps:
                screen = after
            else:  # the part that was drawn is cleared again
                screen = after.copy()
                screen[top : top + ph, left : left + pw] = 0
            k += 1

    clip_kind = to_arrow_type(needed.schema["clip_id"].dataType)
    return rows.mapInArrow(run, schema)
