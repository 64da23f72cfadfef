"""Numbered still pictures and uncompressed video as frames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.functions import pixels
from cadenza.operators.sampling import natural_key

from . import video
from .shared import file_system

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """RGBA of a PNG: all colour types, depths 1 to 16, not interlaced."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, parts, palette, alpha, head = 8, [], None, b"", None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("an interlaced PNG")
    channels = PNG_CHANNELS[colour]
    step, row = max(1, channels * depth // 8), (w * channels * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, row + 1)
    lines = np.zeros((h + 1, row + step), np.uint8)  # a line of zeros above, and zeros to the left
    for y in range(h):
        kind, x = raw[y, 0], raw[y, 1:]
        up, out = lines[y], lines[y + 1]
        if kind == 0:
            out[step:] = x
        elif kind == 2:
            out[step:] = x + up[step:]
        elif kind == 1:
            for k in range(step):
                out[step + k :: step] = np.cumsum(x[k::step], dtype=np.uint8)
        else:
            for k in range(row):
                a, b, c = int(out[k]), int(up[step + k]), int(up[k])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                out[step + k] = (int(x[k]) + guess) & 255
    lines = lines[1:, step:]
    if depth == 16:
        values = lines.reshape(h, w, channels, 2)[..., 0]
    elif depth == 8:
        values = lines.reshape(h, w, channels)
    else:
        bits = np.unpackbits(lines, axis=1)[:, : w * channels * depth].reshape(h, w, channels, depth)
        values = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)
        if colour != 3:
            values = (values.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    solid = np.full((h, w, 1), 255, np.uint8)
    if colour == 3:
        clear = np.full(256, 255, np.uint8)
        clear[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        return np.concatenate([palette[values[..., 0]], clear[values]], axis=-1)
    if colour in (0, 4):
        values = np.concatenate([np.repeat(values[..., :1], 3, axis=-1), values[..., 1:]], axis=-1)
    return values if values.shape[-1] == 4 else np.concatenate([values, solid], axis=-1)


def encode_png(rgba: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = rgba.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, -1)], axis=1)
    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_pictures(rows: DataFrame, data: str = "png") -> DataFrame:
    """width, height and rgba instead of the encoded pictures in a column; late, so that filters before it save the work."""
    keep = [c for c in rows.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode_png(x) for x in batch.column(data).to_pylist()]
            more = [pa.array([x.shape[1] for x in out], pa.int32()), pa.array([x.shape[0] for x in out], pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], names=[*keep, "width", "height", "rgba"])

    return rows.mapInArrow(run, rows.drop(data).schema.add("width", "integer").add("height", "integer").add("rgba", "binary"))


def png_sequences(spark: SparkSession, path: str, fps: float = 20.0, speed: float = 1.0, sort: bool = True) -> DataFrame:
    """Frames of the PNG files at a path: a clip per folder, in the order of the numbers in their names (or of the
    names as they are), frame i at i / (fps speed). All frames are kept."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    found = found.select(F.regexp_extract("path", "^(.*)/", 1).alias("clip_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path")
    w = Window.partitionBy("clip_id").orderBy(natural_key(F.col("name")) if sort else F.col("name"), "name")
    # only names are ordered; what is in a file is fetched by the task that decodes it
    order = found.select("clip_id", (F.row_number().over(w) - 1).cast("long").alias("frame_index"), "path")
    named = order.withColumn("pts", F.col("frame_index") / F.lit(fps * speed)).repartition("clip_id", "frame_index")
    return decode_pictures(fetched(named, "path", "png").drop("path"))


def fetched(rows: DataFrame, path: str, out: str) -> DataFrame:
    """``out`` (binary): what the file at ``path`` holds, one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own in enumerate(batch.column(path).to_pylist()):
                fs, at = file_system(own)
                with fs.open_input_stream(at) as data:
                    yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([data.read()], pa.binary())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, StructType([*rows.schema]).add(out, "binary"))


def y4m_videos(spark: SparkSession, path: str, fps: float | None = None, speed: float = 1.0, matrix: str | None = None) -> DataFrame:
    """Frames of the Y4M files at a path, by the splittable source (see ``video.read``)."""
    return video.read(spark, path, fps, speed, matrix)
