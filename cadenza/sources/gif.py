"""GIF files: frames compressed in parallel and joined per clip; and back to whole pictures."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from . import lzw

DISPOSE = {"keep": 1, "background": 2, "previous": 3}


def frame_block(left: int, top: int, width: int, height: int, indices: np.ndarray, palette: np.ndarray, clear: int, loss: int = 0) -> bytes:
    """An image with its palette, without what says how long it is shown."""
    size = max(2, 1 << max(1, int(max(len(palette), clear + 1, 2) - 1).bit_length()))
    table = np.zeros((size, 3), np.uint8)
    table[: len(palette)] = palette
    flags = 0x80 | (size.bit_length() - 2)
    min_bits = max(2, size.bit_length() - 1)
    codes = lzw.encode(indices, min_bits, table[: max(len(palette), 1)], loss, clear)
    blocks = b"".join(bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255))
    return struct.pack("<BHHHHB", 0x2C, left, top, width, height, flags) + table.tobytes() + bytes([min_bits]) + blocks + b"\0"


def control_block(delay: int, dispose: str, clear: int) -> bytes:
    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, DISPOSE[dispose] << 2 | (clear >= 0), delay, max(clear, 0), 0)


def header(width: int, height: int, repeat: int | None, comment: bytes = b"") -> bytes:
    """repeat: None plays once, 0 for ever, n n times."""
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x70, 0, 0)
    if repeat is not None:
        out += b"\x21\xff\x0bNETSCAPE2.0" + struct.pack("<BBHB", 3, 1, repeat, 0)
    if comment:
        out += b"\x21\xfe" + bytes([min(len(comment), 255)]) + comment[:255] + b"\0"
    return out


def compressed(parts: DataFrame, loss: int = 0) -> DataFrame:
    """``block`` (binary) instead of ``indices`` and ``palette`` of ``palette.assemble``'s rows. Frame by frame, no shuffle."""
    keep = [c for c in parts.columns if c not in ("indices", "palette")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.append(frame_block(r["left"], r["top"], r["width"], r["height"], np.frombuffer(r["indices"], np.uint8), np.frombuffer(r["palette"], np.uint8).reshape(-1, 3), r["clear"], loss))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "block"])

    return parts.mapInArrow(run, StructType([f for f in parts.schema if f.name in keep]).add("block", "binary"))


NEEDED = ["clip_id", "frame_index", "screen_width", "screen_height", "delay", "dispose", "clear", "block"]


def _pieces(batches: Iterator[pa.RecordBatch], repeat: int | None) -> Iterator[tuple[object, bytes, bool]]:
    """(clip, bytes, whether they begin it) of rows in order of clip and frame; a trailer ends each clip."""
    own, open_ = None, False
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in NEEDED}
            if not open_ or r["clip_id"] != own:
                if open_:
                    yield own, b"\x3b", False
                own, open_ = r["clip_id"], True
                yield own, header(r["screen_width"], r["screen_height"], repeat), True
            yield own, control_block(r["delay"], r["dispose"], r["clear"]) + r["block"], False
    if open_:
        yield own, b"\x3b", False


def files(blocks: DataFrame, repeat: int | None = 0) -> DataFrame:
    """A row per clip: clip_id, frames, ``gif`` (binary). Needs ``compressed``'s columns and ``delay`` (ticks). Rows stream
    past; the file under way is held, as it is one cell in the end (``write_files`` holds none)."""
    rows = blocks.select(*NEEDED).repartition("clip_id").sortWithinPartitions("clip_id", "frame_index")
    clip_kind = to_arrow_type(rows.schema["clip_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        for clip, data, _ in _pieces(batches, repeat):
            parts.append(data)
            if data == b"\x3b":
                yield pa.RecordBatch.from_arrays([pa.array([clip], clip_kind), pa.array([len(parts) - 2], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=["clip_id", "frames", "gif"])
                parts = []

    return rows.mapInArrow(run, rows.select("clip_id").schema.add("frames", "integer").add("gif", "binary"))


def write_files(blocks: DataFrame, folder: str, repeat: int | None = 0) -> DataFrame:
    """Write a GIF file per clip to a folder that all executors share: clip_id, path, frames, bytes. Needs the columns that
    ``files`` does; a block at a time is held. A file gets its name when it is whole; if writing fails, nothing is left."""
    rows = blocks.select(*NEEDED).repartition("clip_id").sortWithinPartitions("clip_id", "frame_index")
    clip_kind = to_arrow_type(rows.schema["clip_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, own, frames, size = None, "", 0, 0
        try:
            for clip, data, begins in _pieces(batches, repeat):
                if begins:
                    own, frames, size = f"{base}/.{uuid.uuid4().hex}.tmp", -2, 0
                    out = fs.open_output_stream(own)
                out.write(data)
                frames, size = frames + 1, size + len(data)
                if data == b"\x3b":
                    out.close()
                    out = None
                    name = f"{quote(str(clip), safe='')}.gif"
                    fs.move(own, f"{base}/{name}")
                    yield pa.RecordBatch.from_arrays([pa.array([clip], clip_kind), pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([frames], pa.int32()), pa.array([size], pa.int64())], names=["clip_id", "path", "frames", "bytes"])
        finally:
            if out is not None:
                out.close()
                fs.delete_file(own)

    return rows.mapInArrow(run, rows.select("clip_id").schema.add("path", "string").add("frames", "integer").add("bytes", "long"))


def read(data: bytes) -> tuple[int, int, int | None, list[dict]]:
    """(width, height, repeat, frames) of a file; a frame is left, top, indices (2-d), palette, clear, delay, dispose."""
    if data[:4] != b"GIF8":
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, common = 13, np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    repeat, frames, control = None, [], (0, "keep", -1)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, after = blocks(at + 2)
            if kind == 0xF9:
                how = {2: "background", 3: "previous"}.get(body[0] >> 2 & 7, "keep")
                control = (int.from_bytes(body[1:3], "little"), how, body[3] if body[0] & 1 else -1)
            elif kind == 0xFF and body[:11] == b"NETSCAPE2.0":
                repeat = int.from_bytes(body[12:14], "little")
            at = after
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = common
            if flags & 0x80:
                n = 2 << (flags & 7)
                palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
                at += 3 * n
            min_bits = data[at]
            codes, at = blocks(at + 1)
            indices = lzw.decode(codes, min_bits, w * h).reshape(h, w)
            if flags & 0x40:  # rows in four passes
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                straight = np.empty_like(indices)
                straight[order] = indices
                indices = straight
            frames.append({"left": left, "top": top, "indices": indices, "palette": palette, "clear": control[2], "delay": control[0], "dispose": control[1]})
            control = (0, "keep", -1)
        else:
            raise ValueError("a GIF block of unknown kind")
    return width, height, repeat, frames


def pictures(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(delay, RGBA) of every frame as it is on screen."""
    width, height, _, frames = read(data)
    screen = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = screen.copy() if f["dispose"] == "previous" else None
        h, w = f["indices"].shape
        part = screen[f["top"] : f["top"] + h, f["left"] : f["left"] + w]
        own = (f["indices"] != f["clear"])[: part.shape[0], : part.shape[1]]
        part[own, :3] = f["palette"][f["indices"][: part.shape[0], : part.shape[1]][own]]
        part[own, 3] = 255
        yield f["delay"], screen.copy()
        if f["dispose"] == "background":
            part[:] = 0
        elif before is not None:
            screen = before


def read_clips(files: DataFrame, speed: float = 1.0) -> DataFrame:
    """Frames (clip_id, frame_index, pts, width, height, rgba, delay) of files in the columns clip_id and ``gif``; a frame's
    time is the sum of the delays before it."""
    kind = files.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["clip_id", "frame_index", "pts", "width", "height", "rgba", "delay"]
        for batch in batches:
            for clip, data in zip(batch.column("clip_id").to_pylist(), batch.column("gif").to_pylist()):
                at = 0
                for k, (delay, rgba) in enumerate(pictures(data)):
                    row = (clip, k, at / (100 * speed), rgba.shape[1], rgba.shape[0], rgba.tobytes(), delay)
                    kinds = [batch.schema.field("clip_id").type, pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)
                    at += delay

    return files.select("clip_id", "gif").mapInArrow(run, f"clip_id {kind}, frame_index long, pts double, width int, height int, rgba binary, delay int")


def read_files(spark, path: str, speed: float = 1.0) -> DataFrame:
    """Frames of the GIF files at a path; the clip is the file's path."""
    found = spark.read.format("binaryFile").load(path).filter(F.substring("content", 1, 4) == F.unhex(F.lit("47494638")))
    return read_clips(found.select(F.col("path").alias("clip_id"), F.col("content").alias("gif")), speed)
