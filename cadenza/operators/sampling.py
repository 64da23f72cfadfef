"""Orders, chunks and even samples of numbered frames, without random choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """An array that sorts names by the numbers in them: what isn't digits as it is, and numbers, however long, by how
    many digits they have without leading zeros and then by these."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    plain = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    number = lambda x: F.struct(F.lit(0).alias("text"), F.length(plain(x)).alias("size"), plain(x).alias("run"))
    return F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(F.struct(F.lit(1).alias("text"), F.lit(0).alias("size"), x.alias("run"))))


def chunk(frames: DataFrame, size: int, index: str = "i", out: str = "chunk") -> DataFrame:
    """Number of the chunk of ``size`` frames that each is in; the last may be short."""
    return frames.withColumn(out, F.expr(f"{index} div {size}L"))


def even_positions(count: Column, k: int) -> Column:
    """array<long>: positions of k of ``count`` things, evenly: (j count + count div 2) div k."""
    n = count.cast("long")
    at = lambda j: F.call_function("div", j.cast("long") * n + F.call_function("div", n, F.lit(2).cast("long")), F.lit(k).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at)


def even_sample(frames: DataFrame, k: int, index: str = "i", count: str = "n") -> DataFrame:
    """k frames of each clip, evenly spaced (all if it has no more)."""
    return frames.filter((F.col(count) <= k) | F.array_contains(even_positions(F.col(count), k), F.col(index).cast("long")))


def even_chunks(frames: DataFrame, chunks: int, size: int, index: str = "i", count: str = "n") -> DataFrame:
    """``chunks`` chunks of ``size`` frames in a row of each clip, evenly spaced (all frames if there are no more)."""
    n_chunks = F.expr(f"({count} + {size - 1}L) div {size}L")
    own = F.expr(f"{index} div {size}L")
    return frames.filter((F.col(count) <= chunks * size) | F.array_contains(even_positions(n_chunks, chunks), own))


def flattened(chunks: DataFrame, column: str) -> DataFrame:
    """Rows of a column of arrays of arrays, one for each inner element."""
    return chunks.withColumn(column, F.explode(F.flatten(column)))


def kth(values: Column, k: int) -> Column:
    """The k-th least of an array, from 0; null where it has no so many."""
    return F.get(F.array_sort(values), k)
