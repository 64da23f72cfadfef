"""Uncompressed video (Y4M) as a data source of Spark: ``spark.read.format("y4m")`` after ``register``.

A file's frames have one size, so a file is cut into byte ranges, and a task reads the header and the frames that
begin in its range. Which frames a lower rate keeps, and their numbers, follow from a frame's own number: of those
that go no byte of the picture is read. Files with frame headers of their own length can't be cut and are one range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cadenza.functions import pixels

from .shared import file_system

SCHEMA = "clip_id string, frame_index long, pts double, width int, height int, rgba binary"
MARK = b"FRAME\n"
#: Bytes of a range, and of the start of a file in which its header ends.
RANGE_BYTES, HEAD_BYTES = 64_000_000, 4096


def header(data: bytes) -> dict:
    """Of the start of an uncompressed video: width, height, fps (two numbers), sizes of a frame's planes, range and where
    the header ends. Monochrome and more than 8 bits are errors."""
    line = data[: data.index(b"\n")].decode()
    if not line.startswith("YUV4MPEG2"):
        raise ValueError("not a Y4M file")
    fields = line.split(" ")[1:]
    first = lambda k, none: next((f[1:] for f in fields if f[:1] == k), none)
    w, h, name = int(first("W", "0")), int(first("H", "0")), first("C", "420")
    if w < 1 or h < 1 or "p1" in name or name.startswith("mono"):
        raise ValueError(f"unsupported Y4M: {line}")
    sx, sy = {"444": (1, 1), "422": (2, 1), "420": (2, 2)}[name[:3]]
    cw, ch = -(-w // sx), -(-h // sy)
    num, _, den = first("F", "20:1").partition(":")
    return {"width": w, "height": h, "fps": (int(num), int(den or 1)), "planes": [(h, w), (ch, cw), (ch, cw)] + ([(h, w)] if "alpha" in name else []), "full": "COLORRANGE=FULL" in line, "start": len(line.encode()) + 1}


def frame_bytes(head: dict) -> int:
    """Bytes of a frame with a plain mark before it."""
    return len(MARK) + sum(h * w for h, w in head["planes"])


def kept_number(i: int, own: Fraction, wanted: Fraction | None) -> int | None:
    """The number of frame i after coming down to the wanted rate; none if it goes (frame 0 stays)."""
    if wanted is None or own <= wanted or not i:
        return i
    before = i * wanted // own
    return 1 + before if (i + 1) * wanted // own > before else None


def frames_of_range(start: int, end: int, size: int, head: dict) -> range:
    """Numbers of the frames that begin at bytes ``start`` to ``end`` of a file of ``size`` bytes; cut ones don't count."""
    step, base = frame_bytes(head), head["start"]
    whole = (size - base) // step
    first = max(0, -(-(start - base) // step))
    return range(first, max(first, min(whole, -(-(end - base) // step))))


@dataclass
class Range(InputPartition):
    path: str
    clip: str
    start: int
    end: int
    size: int


class VideoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        """Byte ranges of all files; only names and sizes are looked up here."""
        fs, at = file_system(self.options["path"])
        info = fs.get_file_info(at)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        step = int(self.options.get("rangebytes", RANGE_BYTES))
        prefix = self.options["path"].rstrip("/")
        ranges = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type == pafs.FileType.File and f.path.endswith(".y4m"):
                clip = prefix + f.path[len(at.rstrip("/")):]
                ranges += [Range(f.path, clip, a, min(a + step, f.size), f.size) for a in range(0, f.size, step)]
        return ranges

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.options["path"])
        matrix, speed = self.options.get("matrix"), float(self.options.get("speed", 1.0))
        wanted = Fraction(float(self.options["fps"])).limit_denominator(100_000) if "fps" in self.options else None
        with fs.open_input_file(part.path) as file:
            head = header(file.read_at(min(HEAD_BYTES, part.size), 0))
            own = Fraction(*head["fps"])
            matrix = matrix or ("bt601" if head["width"] <= 720 and head["height"] <= 480 else "bt709")
            for i, planes in self._frames(file, part, head, lambda i: kept_number(i, own, wanted) is not None):
                rgba = pixels.yuv_to_rgba(*planes[:3], matrix=matrix, full=head["full"])
                row = part.clip, kept_number(i, own, wanted), float(i / own) / speed, rgba.shape[1], rgba.shape[0], rgba.tobytes()
                kinds = pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["clip_id", "frame_index", "pts", "width", "height", "rgba"])

    def _frames(self, file: pa.NativeFile, part: Range, head: dict, keeps) -> Iterator[tuple[int, list[np.ndarray]]]:
        step, base = frame_bytes(head), head["start"]
        bodies = step - len(MARK)
        plain = part.size == base or file.read_at(len(MARK), base) == MARK and (part.size - base) % step == 0
        if plain:
            for i in frames_of_range(part.start, part.end, part.size, head):
                if keeps(i):
                    data = file.read_at(step, base + i * step)
                    if data[: len(MARK)] != MARK:
                        raise ValueError(f"{part.path}: frames of one length begin with {MARK!r}")
                    yield i, self._planes(data[len(MARK):], head)
        elif part.start == 0:  # frame headers of any length: one task goes through the file
            at, i = base, 0
            while at < part.size:
                line = file.read_at(256, at)
                at += line.index(b"\n") + 1
                if at + bodies > part.size:
                    return
                if keeps(i):
                    yield i, self._planes(file.read_at(bodies, at), head)
                at, i = at + bodies, i + 1

    def _planes(self, data: bytes, head: dict) -> list[np.ndarray]:
        found, at = [], 0
        for h, w in head["planes"]:
            found.append(np.frombuffer(data, np.uint8, h * w, at).reshape(h, w))
            at += h * w
        return found


class VideoSource(DataSource):
    """Options: path (a file, or a folder with *.y4m), fps (frames are dropped to come down to it), speed (divides times),
    matrix (else by the size), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VideoReader:
        return VideoReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VideoSource)


def read(spark: SparkSession, path: str, fps: float | None = None, speed: float = 1.0, matrix: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of the Y4M files at a path; the clip is the file's path. With ``fps`` frames are dropped to come down to
    it; what decides is the time as filmed, and only the times that come out are divided by ``speed``."""
    register(spark)
    options = {"speed": speed, "rangeBytes": range_bytes} | ({} if fps is None else {"fps": fps}) | ({} if matrix is None else {"matrix": matrix})
    return spark.read.format("y4m").options(**options).load(path)


def write_files(planes: DataFrame, folder: str, fps: tuple[int, int] = (20, 1), full: bool = True) -> DataFrame:
    """A Y4M file (4:4:4) per clip in a folder that all executors share, of planes (clip_id, frame_index, width, height,
    ``yuv``: y, u, v of all pixels, plane after plane): clip_id, path, frames. A frame at a time is held; a file gets its
    name when it is whole."""
    rows = planes.select("clip_id", "frame_index", "width", "height", "yuv").repartition("clip_id").sortWithinPartitions("clip_id", "frame_index")
    schema = rows.select("clip_id").schema.add("path", "string").add("frames", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        own, out, temp, n, kind = None, None, "", 0, None

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(temp, f"{base}/{own}.y4m")
            return pa.RecordBatch.from_arrays([pa.array([own], kind), pa.array([f"{folder.rstrip('/')}/{own}.y4m"]), pa.array([n], pa.int64())], names=["clip_id", "path", "frames"])

        for batch in batches:
            kind = batch.column("clip_id").type
            for r in batch.to_pylist():
                if out is None or r["clip_id"] != own:
                    if out is not None:
                        yield close()
                    own, n, temp = r["clip_id"], 0, f"{base}/.{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(temp)
                    out.write(f"YUV4MPEG2 W{r['width']} H{r['height']} F{fps[0]}:{fps[1]} C444{' XCOLORRANGE=FULL' * full}\n".encode())
                out.write(MARK + r["yuv"])
                n += 1
        if out is not None:
            yield close()

    return rows.mapInArrow(run, schema)


def planes_of(frames: DataFrame) -> DataFrame:
    """``yuv`` of frames whose red, green and blue are brightness and the two colours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if x is None else np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(-1, 4)[:, :3].T).tobytes() for x in batch.column("rgba").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(data, pa.binary())], names=[*keep, "yuv"])

    keep = [c for c in frames.columns if c != "rgba"]
    return frames.withColumn("frame_index", F.col("frame_index").cast("long")).mapInArrow(run, frames.withColumn("frame_index", F.col("frame_index").cast("long")).select(*keep).schema.add("yuv", "binary"))
