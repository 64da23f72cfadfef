"""The LZW code stream of GIF pictures: lossless, or trading small colour errors for longer matches."""

from __future__ import annotations

import numpy as np

MOST_CODES = 4096
#: A full table is kept while the mean run is at least this share of its best; runs of near colours followed at once.
KEEP_TABLE, PATHS = 0.75, 4


class CodeWriter:
    """Codes of growing width, lowest bit first, with the table that the reader will have."""

    def __init__(self, min_bits: int):
        self.clear, self.end, self.min_bits = 1 << min_bits, (1 << min_bits) + 1, min_bits
        self.data, self.bits, self.out = 0, 0, bytearray()
        self.table: dict[tuple[int, int], int] = {}
        self.next, self.width = self.end + 1, min_bits + 1
        self.typical = self.best = 0.0
        self.put(self.clear)

    def put(self, code: int) -> None:
        self.data |= code << self.bits
        self.bits += self.width
        while self.bits >= 8:
            self.out.append(self.data & 255)
            self.data >>= 8
            self.bits -= 8

    def run(self, code: int, length: int, following: int) -> None:
        """Write a run's code and learn the run with the pixel that follows. A full table stays in use while runs are about
        as long as they have been; when their running mean falls behind, it is begun anew."""
        self.put(code)
        if self.next < MOST_CODES:
            self.table[code, following] = self.next
            if self.next == 1 << self.width and self.width < 12:
                self.width += 1
            self.next += 1
            self.typical = self.best = 0.0
            return
        self.typical = self.typical + (length - self.typical) / 16 if self.typical else float(length)
        self.best = max(self.best, self.typical)
        if self.typical < KEEP_TABLE * self.best:
            self.put(self.clear)
            self.table.clear()
            self.next, self.width = self.end + 1, self.min_bits + 1

    def finish(self, code: int | None) -> bytes:
        if code is not None:
            self.put(code)
            if self.next == 1 << self.width and self.width < 12 and self.next < MOST_CODES:
                self.width += 1
        self.put(self.end)
        if self.bits:
            self.out.append(self.data & 255)
        return bytes(self.out)


def encode(indices: np.ndarray, min_bits: int, palette: np.ndarray | None = None, loss: int = 0, clear_index: int = -1) -> bytes:
    """Codes for pixel indices, lowest bit first. With ``loss`` a pixel may be written as another colour whose distance
    to it is at most ``loss``, where that makes a known run longer; clear pixels never change."""
    writer, pixels = CodeWriter(min_bits), indices.reshape(-1).tolist()
    if loss and palette is not None:
        return encode_near(pixels, writer, similar_colours(palette, loss, clear_index))
    table = writer.table
    run, length = None, 0
    for x in pixels:
        if run is None:
            run, length = x, 1
        elif (code := table.get((run, x))) is not None:
            run, length = code, length + 1
        else:
            writer.run(run, length, x)
            run, length = x, 1
    return writer.finish(run)


def encode_near(pixels: list[int], writer: CodeWriter, near: list[list[tuple[int, int]]]) -> bytes:
    """Each run is the longest known one whose pixels are all near enough; of several that long, that with the least
    error among the PATHS best at each pixel."""
    table, at, n = writer.table, 0, len(pixels)
    while at < n:
        x = pixels[at]
        paths = [(0, x)]  # the reader learns the run before with this pixel, so it is exact
        best, k = x, at + 1
        while True:
            best = min(paths)[1]
            if k == n:
                break
            x = pixels[k]
            longer = [(e, c) for e, code in paths if (c := table.get((code, x))) is not None]
            longer += [(e + d, c) for e, code in paths for d, y in near[x] if (c := table.get((code, y))) is not None]
            if not longer:
                break
            paths = sorted(longer)[:PATHS]
            k += 1
        if k == n:
            return writer.finish(best)
        writer.run(best, k - at, pixels[k])
        at = k
    return writer.finish(None)


def similar_colours(palette: np.ndarray, loss: int, clear_index: int, most: int = 16) -> list[list[tuple[int, int]]]:
    """For each index the other colours within ``loss`` (distance, index), up to ``most``, nearest first."""
    p = palette.astype(np.int64)
    d = ((p[:, None] - p[None]) ** 2 * np.array([2, 3, 1])).sum(axis=2)
    found = []
    for i in range(max(len(p), clear_index + 1)):
        if i == clear_index or i >= len(p):
            found.append([])
            continue
        order = np.argsort(d[i], kind="stable")
        found.append([(int(d[i, j]), int(j)) for j in order if j != i and j != clear_index and d[i, j] <= loss][:most])
    return found


def decode(data: bytes, min_bits: int, size: int) -> np.ndarray:
    """Up to ``size`` indices of a code stream; what is missing is 0."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last, out = list(start), min_bits + 1, b"", bytearray()
    buffer, bits, at = 0, 0, 0
    while len(out) < size:
        while bits < width and at < len(data):
            buffer |= data[at] << bits
            bits += 8
            at += 1
        if bits < width:
            break
        code = buffer & (1 << width) - 1
        buffer >>= width
        bits -= width
        if code == clear:
            table, width, last = list(start), min_bits + 1, b""
            continue
        if code == end:
            break
        if not last:
            run = table[code]
        elif code < len(table):
            run = table[code]
        else:
            run = last + last[:1]
        out += run
        if last and len(table) < MOST_CODES:
            table.append(last + run[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        last = run
    found = np.zeros(size, np.uint8)
    found[: min(size, len(out))] = np.frombuffer(bytes(out[:size]), np.uint8)
    return found
