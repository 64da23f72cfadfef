"""Error diffusion: what a pixel's colour lacks is passed on to its neighbours to the right and below.

A pixel waits for its left neighbour and three above it. So pixels on a slanted diagonal, x + 2 y alike, don't wait for
each other, and a picture is done diagonal by diagonal, each at once. Whole numbers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from cadenza.functions import pixels

#: Where what is lacking goes (right, down) and in how many sixteenths.
SHARES = (((1, 0), 7), ((-1, 1), 3), ((0, 1), 5), ((1, 1), 1))
#: Levels are 0 (no diffusion) to this.
FULL = 256


def diffused(rgba: np.ndarray, palette: np.ndarray, level: int = FULL, screen: np.ndarray | None = None) -> np.ndarray:
    """Index of each pixel (height, width) in ``palette`` (n, 3), its number of colours where the pixel is clear.

    A pixel takes its colour with what its neighbours lacked, ``level`` of FULL parts of it, and the nearest of the palette.
    One without colour is clear and neither takes nor passes on anything. One that the ``screen`` (RGBA) shows at least
    as near is clear, too: the screen stays there, and what that lacks is passed on.
    """
    h, w = rgba.shape[:2]
    out = np.full((h, w), len(palette), dtype=np.int64)
    if not len(palette):
        return out
    lacks = np.zeros((h + 1, w + 2, 3), dtype=np.int64)  # in sixteenths, one column more on both sides
    table = palette.astype(np.int64)
    for diagonal in range(w + 2 * (h - 1)):
        y = np.arange(max(0, (diagonal - w + 2) // 2), min(h - 1, diagonal // 2) + 1)
        x = diagonal - 2 * y
        own = rgba[y, x, 3] >= 128
        y, x = y[own], x[own]
        if not len(y):
            continue
        value = np.clip(rgba[y, x, :3] + (lacks[y, x + 1] * level >> 12), 0, 255)
        gaps = pixels.distance(value[:, None], table[None])
        index = gaps.argmin(axis=1)
        taken = table[index]
        if screen is not None:
            under = screen[y, x]
            stays = (under[:, 3] >= 128) & (pixels.distance(under, value) <= gaps.min(axis=1))
            taken = np.where(stays[:, None], under[:, :3].astype(np.int64), taken)
            index = np.where(stays, len(palette), index)
        out[y, x] = index
        for (right, down), share in SHARES:
            lacks[y + down, x + 1 + right] += share * (value - taken)
    return out


def diffused_frames(frames: DataFrame, level: int = FULL) -> DataFrame:
    """``indices`` (binary, a byte a pixel) of frames (width, height, rgba, ``palette``: RGB triples, at most 255, and
    ``screen``: the RGBA that is shown before, or null). Frame by frame; a null picture has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, rgba, palette, screen in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "rgba", "palette", "screen"))):
                image = lambda x: None if x is None else np.frombuffer(x, np.uint8).reshape(h, w, 4)  # noqa: B023, E731
                out.append(None if rgba is None else diffused(image(rgba), np.frombuffer(palette, np.uint8).reshape(-1, 3), level, image(screen)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "indices"])

    return frames.mapInArrow(run, StructType([*frames.schema]).add("indices", "binary"))
