"""What the training-data operators share: a shared work folder, tables that cut lineage, file access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Python-side slices of an Arrow batch hold about so many characters of text at once.
SLICE_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where that is unset and all of Spark runs in one process is a folder of this machine set instead.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_made: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(path: str) -> None:
    """Delete a folder of ``work_dir`` with all in it, if it is there."""
    fs, at = filesystem(path)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        fs.delete_dir(at)
    if path in _made:
        _made.remove(path)


def clean_up() -> None:
    """Delete all that this driver's operators have left in the shared folder. Results that are still to be computed
    read from there: call it when they are written."""
    for path in [*_made]:
        remove(path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and a
    lost executor costs no recomputation."""
    return stored(df, name)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table. One that is too small to give every core a part (a file or two) is dealt out to all of them;
    a larger one is left as its files are, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI or an absolute path, and the path there."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), each of about ``most`` bytes of text or one row."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        part = batch.slice(a, b - a)
        yield part, [x or "" for x in part.column(column).to_pylist()]
