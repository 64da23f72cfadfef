"""GIF files as a data sink of Spark: ``blocks.write.format("gif_clips").option("path", folder)`` after ``register``.

A task writes whole files under a folder of the job's own. Only when all tasks have ended does the driver give them
their names, those of one attempt per task; a job that fails takes its folder with it. So a task that is repeated or
runs twice leaves each file once, and a failed job leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import gif
from .shared import file_system

#: Files that get their names at once.
MOVERS = 32


@dataclass
class Written(WriterCommitMessage):
    """(where an attempt has put a file, the file's name) of a task."""

    files: list[tuple[str, str]] = field(default_factory=list)


class ClipWriter(DataSourceArrowWriter):
    def __init__(self, path: str, repeat: int | None, overwrite: bool):
        self.path, self.repeat, self.overwrite = path, repeat, overwrite
        self.job = f".job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = file_system(self.path)
        attempt, done, out = f"{base}/{self.job}/{uuid.uuid4().hex}", [], None
        fs.create_dir(attempt, recursive=True)
        try:
            for clip, data, begins in gif._pieces(iterator, self.repeat):
                if begins:
                    name = f"{quote(str(clip), safe='')}.gif"
                    done.append((f"{attempt}/{name}", name))
                    out = fs.open_output_stream(done[-1][0])
                out.write(data)
                if data == b"\x3b":
                    out.close()
        except BaseException:
            if out is not None:
                out.close()
            fs.delete_dir(attempt)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.path)
        files = [x for m in messages if m for x in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a clip's rows must be in one partition, in order (see sink.save)")
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(base)):
                if f.type == pafs.FileType.File and f.path.endswith(".gif"):
                    fs.delete_file(f.path)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda x: fs.move(x[0], f"{base}/{x[1]}"), files))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what attempts have left, whoever lost them."""
        fs, base = file_system(self.path)
        if fs.get_file_info(f"{base}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.job}")


class ClipSink(DataSource):
    """Options: path, repeat (0: for ever; none: once)."""

    @classmethod
    def name(cls) -> str:
        return "gif_clips"

    def writer(self, schema, overwrite: bool) -> ClipWriter:
        missing = set(gif.NEEDED) - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        repeat = self.options.get("repeat", "0")
        return ClipWriter(self.options["path"], None if repeat == "none" else int(repeat), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipSink)


def save(blocks: DataFrame, folder: str, repeat: int | None = 0, mode: str = "append") -> None:
    """A GIF file per clip in a folder that all executors share. Needs ``gif.compressed``'s columns and ``delay`` (ticks);
    a block at a time is held."""
    register(blocks.sparkSession)
    rows = blocks.select(*gif.NEEDED).repartition("clip_id").sortWithinPartitions("clip_id", "frame_index")
    rows.write.format("gif_clips").option("path", folder).option("repeat", "none" if repeat is None else repeat).mode(mode).save()
