"""Tables between the steps of an operator, in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder. Only where it is unset and all of Spark runs in one process, it is one of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    _made.append(f"{folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read back: lineage ends there, and what is random in it stays as it came out."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI or an absolute path, and the path there."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def clean_up() -> None:
    """Delete all that this driver's operators have left there. Results that are still to be computed read from it."""
    while _made:
        fs, at = file_system(_made.pop())
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)
