"""Pixel kernels in numpy: an image is an array (height, width, channels) of uint8."""

from __future__ import annotations

import numpy as np

#: Largest colour distance at which a blurred pixel is taken (fixed value).
BLUR_LIMIT = 1536
#: Alpha below which an anti-aliased edge pixel becomes clear, and what counts as clear and solid there (fixed values).
EDGE_CUT, EDGE_CLEAR, EDGE_SOLID = 89, 12, 240
MAGENTA = (255, 0, 255)
#: Shares of red and blue in brightness, by colour matrix (fixed values).
MATRICES = {"bt601": (0.299, 0.114), "bt470bg": (0.299, 0.114), "bt709": (0.2126, 0.0722), "fcc": (0.3, 0.11), "smpte240": (0.212, 0.087), "bt2020": (0.2627, 0.0593)}
CHANNELS = {"rgba": (0, 1, 2, 3), "argb": (1, 2, 3, 0), "bgra": (2, 1, 0, 3), "abgr": (3, 2, 1, 0), "rgb": (0, 1, 2)}


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 dr^2 + 3 dg^2 + db^2 over the last axis."""
    d = a[..., :3].astype(np.int64) - b[..., :3]
    return d * d @ np.array([2, 3, 1])


def neighbours(image: np.ndarray) -> np.ndarray:
    """(9, height, width, channels): each pixel's 3 x 3 surroundings, edges repeated, the pixel itself at 4."""
    h, w = image.shape[:2]
    wide = np.pad(image, ((1, 1), (1, 1), (0, 0)), mode="edge")
    return np.stack([wide[y : y + h, x : x + w] for y in range(3) for x in range(3)])


def blur(rgba: np.ndarray, median: bool = False) -> np.ndarray:
    """RGB of a 3 x 3 mean or median (clear neighbours count as the pixel itself), kept where it is near the pixel's
    own colour; clear pixels become magenta."""
    around = neighbours(rgba)
    colours = np.where(around[..., 3:] > 0, around[..., :3], rgba[None, ..., :3])
    mixed = (np.median(colours, axis=0) if median else colours.sum(axis=0, dtype=np.int64) // 9).astype(np.uint8)
    near = distance(rgba, mixed) < BLUR_LIMIT
    out = np.where(near[..., None], mixed, rgba[..., :3])
    return np.where(rgba[..., 3:] > 0, out, np.array(MAGENTA, np.uint8)).astype(np.uint8)


def ordered_matrix(bits: int) -> np.ndarray:
    """The recursive ordered-dither matrix of side 2**bits."""
    m = np.zeros((1, 1), dtype=np.int64)
    for _ in range(bits):
        m = np.block([[4 * m, 4 * m + 3], [4 * m + 2, 4 * m + 1]])
    return m


def solid_or_clear(rgba: np.ndarray) -> np.ndarray:
    """Alpha made 0 or 255 by an 8 x 8 ordered threshold; at anti-aliased edges by one cut."""
    a = rgba[..., 3]
    around = neighbours(rgba[..., 3:])[..., 0].astype(np.int64)
    edge = np.zeros(a.shape, dtype=bool)
    for i, j in ((1, 7), (3, 5), (0, 8), (2, 6)):
        x, y = around[i], around[j]
        edge |= ((x < EDGE_CLEAR) & (y >= EDGE_SOLID)) | ((y < EDGE_CLEAR) & (x >= EDGE_SOLID))
    h, w = a.shape
    table = ordered_matrix(3) * 2 + 8
    threshold = np.where(edge & (a > 0) & (a < 255), EDGE_CUT, np.tile(table, (h // 8 + 1, w // 8 + 1))[:h, :w])
    out = rgba.copy()
    out[..., 3] = np.where(a == 255, 255, np.where(a < threshold, 0, 255))
    return out


def over_matte(rgba: np.ndarray, matte: tuple[int, int, int]) -> np.ndarray:
    """Half-transparent pixels blended over a background and made solid."""
    a = rgba[..., 3:].astype(np.int64)
    mixed = (rgba[..., :3] * a + np.array(matte) * (255 - a)) // 255
    half = (a > 0) & (a < 255)
    return np.concatenate([np.where(half, mixed, rgba[..., :3]), np.where(half, 255, a)], axis=-1).astype(np.uint8)


def unpack(data: bytes, width: int, height: int, layout: str = "rgba", stride: int | None = None, premultiplied: bool = False) -> np.ndarray:
    """RGBA from raw bytes of another channel order, with ``stride`` pixels a row. Bad sizes are errors. With
    ``premultiplied`` colours hold their alpha already, which is taken out of them."""
    order = CHANNELS[layout]
    n = len(order)
    stride = width if stride is None else stride
    if not (1 <= width <= 65_535 and 1 <= height <= 65_535) or stride < width or len(data) < ((height - 1) * stride + width) * n:
        raise ValueError("a frame is 1 to 65535 pixels a side, and its rows must fit the stride and the data")
    whole = np.frombuffer(data, np.uint8, ((height - 1) * stride + width) * n)
    rows = np.concatenate([whole, np.zeros((stride - width) * n, np.uint8)]).reshape(height, stride, n)[:, :width]
    out = rows[..., list(order)]
    if n == 3:
        return np.concatenate([out, np.full((height, width, 1), 255, np.uint8)], axis=-1)
    if premultiplied:
        a = out[..., 3:].astype(np.int64)
        plain = np.minimum((out[..., :3].astype(np.int64) * 255 + a // 2) // np.maximum(a, 1), 255)
        out = np.concatenate([np.where(a > 0, plain, 0), a], axis=-1).astype(np.uint8)
    return np.ascontiguousarray(out)


def crop(image: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray | None:
    """A part of an image; None if it isn't all inside."""
    if x < 0 or y < 0 or width < 1 or height < 1 or x + width > image.shape[1] or y + height > image.shape[0]:
        return None
    return image[y : y + height, x : x + width]


def copy_plane(data: bytes, height: int, stride: int, to_height: int, to_stride: int) -> bytes:
    """Rows of one stride as rows of another: the shorter row's bytes of each, the rest 0. Heights must agree."""
    if height != to_height or len(data) < height * stride:
        raise ValueError("planes must be of one height, with all their rows")
    out = np.zeros((height, to_stride), np.uint8)
    n = min(stride, to_stride)
    out[:, :n] = np.frombuffer(data, np.uint8, height * stride).reshape(height, stride)[:, :n]
    return out.tobytes()


def lanczos_weights(size: int, to: int, lobes: int = 3) -> np.ndarray:
    """(to, size): how much each source pixel adds to each target pixel."""
    scale = max(size / to, 1.0)
    centre = (np.arange(to) + 0.5) * size / to - 0.5
    x = (np.arange(size)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0)
    return w / w.sum(axis=1, keepdims=True)


def resize(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """By Lanczos' kernel, colours weighted by alpha; the same size is returned as it is."""
    h, w = rgba.shape[:2]
    if (w, h) == (width, height):
        return rgba
    a = rgba[..., 3:].astype(np.float64)
    x = np.concatenate([rgba[..., :3] * a, a], axis=-1)
    x = np.einsum("yh,hwc->ywc", lanczos_weights(h, height), x, optimize=True)
    x = np.einsum("xw,ywc->yxc", lanczos_weights(w, width), x, optimize=True)
    alpha = x[..., 3:]
    colour = np.divide(x[..., :3], alpha, out=np.zeros_like(x[..., :3]), where=alpha > 0.5)
    return np.clip(np.round(np.concatenate([colour, alpha], axis=-1)), 0, 255).astype(np.uint8)


def changed_box(before: np.ndarray, after: np.ndarray) -> tuple[int, int, int, int]:
    """(left, top, width, height) of what differs; one pixel if nothing does."""
    differs = (before != after).any(axis=-1) if before.ndim == 3 else before != after
    ys, xs = np.flatnonzero(differs.any(axis=1)), np.flatnonzero(differs.any(axis=0))
    if not len(ys):
        return 0, 0, 1, 1
    return int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)


def yuv_to_rgba(y: np.ndarray, u: np.ndarray, v: np.ndarray, matrix: str = "bt709", full: bool = False) -> np.ndarray:
    """Planes of 8-bit video; smaller chroma planes are repeated to the size of y."""
    h, w = y.shape
    up = lambda p: np.repeat(np.repeat(p, -(-h // p.shape[0]), axis=0), -(-w // p.shape[1]), axis=1)[:h, :w].astype(np.float64) - 128
    luma = y.astype(np.float64) if full else (y.astype(np.float64) - 16) * 255 / 219
    chroma = 1.0 if full else 255 / 224
    b, r = up(u) * chroma, up(v) * chroma
    if matrix == "ycgco":  # differences from green and of orange
        red, green, blue = luma - b + r, luma + b, luma - b - r
    else:
        kr, kb = MATRICES[matrix]
        red, blue = luma + 2 * (1 - kr) * r, luma + 2 * (1 - kb) * b
        green = (luma - kr * red - kb * blue) / (1 - kr - kb)
    rgb = np.clip(np.round(np.stack([red, green, blue], axis=-1)), 0, 255)
    return np.concatenate([rgb, np.full((h, w, 1), 255)], axis=-1).astype(np.uint8)
