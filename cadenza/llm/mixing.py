"""Mixing sources to target weights by pivotal dependent rounding.

A source's target in words, over its size, is how often each of its documents should be taken: a whole number and a
fraction. Fractions are rounded in pairs: of two documents' fractional words, as many as fit move from one to the
other, which way being drawn so that no expectation changes, until one of the two is taken or left. Since words and
not copies move, a source's sum stays what it was; only the one fraction that is left in the end is rounded alone.

Documents of a source are dealt out to groups of about ``GROUP_ROWS`` by a hash, in each of which the longest meet
first, so that what remains is short. What a group leaves goes up a tree, ``FAN`` groups to one, until a source has
one left: one row per group moves per level, and no group is larger for a larger source. Draws come from hashes of
the rows, so results don't depend on how rows lie in partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A word.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; and how often a source may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of a leaf of the tree, about, and groups that are joined to one.
GROUP_ROWS, FAN = 1_000, 64
#: Equal rows that are listed at once.
EQUAL_ROWS = 100_000
_WRAP = (1 << 64) - 1


def draw(seed: int, *keys: int) -> float:
    """A number from 0 to 1 (without) that depends on the keys and their order alone."""
    x = seed & _WRAP
    for k in keys:
        x = (x ^ (k & _WRAP)) * 0x9E3779B97F4A7C15 & _WRAP
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WRAP
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _WRAP
        x ^= x >> 31
    return (x >> 11) / (1 << 53)


def pivot(p: float, size: int, q: float, other: int, u: float) -> tuple[float, float]:
    """Two fractions (above 0, below 1) of documents of these sizes after the transfer that ``u`` (0 to 1) chooses.
    One of them at least is 0 or 1 then; the sum of words stays, and so do both expectations."""
    to_first = min((1 - p) * size, q * other)
    to_second = min(p * size, (1 - q) * other)
    if u * (to_first + to_second) < to_second:
        if (1 - p) * size <= q * other:
            return 1.0, max(0.0, q - to_first / other)
        return min(1.0, p + to_first / size), 0.0
    if p * size <= (1 - q) * other:
        return 0.0, min(1.0, q + to_second / other)
    return max(0.0, p - to_second / size), 1.0


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """For sources (``source``, ``source_size``; distinct): ``number`` (long: their place by code point, null last) and
    ``target``: shares of all sizes by the weights, repeating; where a share is above ``most`` times a source's size it
    stops there, and the others take the excess by their weights, until none is above.

    The level that the open sources share is found by rounds of one aggregate each, so any number of sources will do.
    """
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    ranged = common.cut(ranged, "sources")
    parts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per task
    parts = parts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    numbered = ranged.join(parts, "__part").withColumn("number", (F.col("__before") + place).cast("long")).drop("__part", "__before")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    numbered = common.cut(numbered.withColumn("__weight", weight), "sources")

    def full(level: float | None) -> Column:
        return F.lit(False) if level is None else F.col("source_size") * most <= F.col("__weight") * level

    level, before = None, None
    while True:
        total, held, still_open, n = numbered.agg(
            F.sum("source_size"),
            F.sum(F.when(full(level), F.col("source_size") * float(most)).otherwise(0.0)),
            F.sum(F.when(full(level), 0.0).otherwise(F.col("__weight"))),
            F.count(F.when(full(level), 1)),
        ).first()
        if n == before or not still_open:
            break
        level, before = (total - held) / still_open, n
    share = F.when(full(level), F.col("source_size") * float(most)).otherwise(F.col("__weight") * F.lit(level if level is not None else 0.0))
    return numbered.withColumn("target", share.cast("double")).drop("__weight")


def settled(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """Round the fractions ``p`` of each (number, bucket). Of a group one row at most keeps a fraction, none if ``last``;
    the others have their copies, and a null ``p``."""
    ordered = rows.repartition("number", "bucket").sortWithinPartitions("number", "bucket", F.desc("size"), "key", "doc_id")
    names, id_type = rows.columns, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, None, []

        def settle(row: dict, p: float) -> None:
            row["copies"] += p >= 1
            row["p"] = None
            out.append(row)

        def close() -> None:
            if held is not None:
                if last:
                    settle(held, 1.0 if draw(seed, -1 - level, held["key"]) < held["p"] else 0.0)
                else:
                    out.append(held)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in zip(names, id_type)], names=names)

        for batch in batches:
            id_type[:] = batch.schema.types
            for row in batch.to_pylist():
                if (row["number"], row["bucket"]) != group:
                    close()
                    group, held = (row["number"], row["bucket"]), None
                if not 0 < row["p"] < 1:
                    settle(row, row["p"])
                elif held is None:
                    held = row
                else:
                    held["p"], row["p"] = pivot(held["p"], held["size"], row["p"], row["size"], draw(seed, level, held["key"], row["key"]))
                    both, held = (held, row), None
                    for x in both:
                        if 0 < x["p"] < 1:
                            held = x
                        else:
                            settle(x, x["p"])
            yield batch_of()
            out.clear()
        close()
        if out:
            yield batch_of()

    return ordered.mapInArrow(run, rows.schema)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken, so that sources have words by their weights.

    Returns doc_id, source, size (long: words of the text; null: 0), source_size (long), target (double: its source's,
    see ``targets``), copies (int, at most ``most`` rounded up) and taken (long: copies times size). A row per input row;
    equal rows are interchangeable, and other columns are left behind. A source's taken words differ from its target by
    less than one document, usually a short one. Empty documents have no copies. A null source is a source, the last
    one. What a row gets depends on the rows alone, not on how they lie in files or partitions.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sized = rows.select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text", "source").alias("key"))
    # equal rows are counted and dealt out again, each with a key of its own, whatever parts of the input they are in
    sized = sized.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n"))
    last = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    sized = sized.withColumn("some", F.explode(last(F.ceil(F.col("n") / EQUAL_ROWS))))
    sized = sized.withColumn("one", F.explode(last(F.least(F.lit(EQUAL_ROWS), F.col("n") - F.col("some") * EQUAL_ROWS))))
    sized = common.cut(sized.select("doc_id", "source", "size", F.xxhash64("key", "some", "one").alias("key")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_docs"))
    sources = common.cut(targets(sources, weights, most), "targets")
    shares = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    groups = F.greatest(F.ceil(F.col("n_docs") / GROUP_ROWS), F.lit(1))
    per = sources.select(F.col("source").alias("__source"), "number", shares.alias("__share"), groups.alias("__groups"))
    known = sized.join(per, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    whole = F.floor("__share")
    rows = known.select("doc_id", "number", "size", "key", F.pmod("key", "__groups").cast("long").alias("bucket"), F.when(F.col("size") > 0, whole).otherwise(0).cast("int").alias("copies"), F.when(F.col("size") > 0, F.col("__share") - whole).otherwise(0.0).alias("p"))
    left, pending, done, level = sources.agg(F.max(groups)).first()[0] or 1, rows.filter("p > 0 and p < 1"), [rows.filter("not (p > 0 and p < 1)")], 0
    while True:
        table = common.cut(settled(pending, level, seed, left == 1), "mixed")
        done.append(table.filter("p is null"))
        if left == 1:
            break
        left, level = -(-left // FAN), level + 1
        pending = table.filter("p is not null").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
    found = done[0]
    for x in done[1:]:
        found = found.union(x)
    return found.join(sources.select("number", "source", "source_size", "target"), "number").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of ``docs`` (ids distinct and not null), each as often as ``mixed`` takes it, with ``copy`` (int, from 1)."""
    taken = mixed.filter("copies > 0").select(F.col("doc_id").alias("__id"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return docs.drop("copy").join(taken, F.col(id_col) == F.col("__id")).drop("__id")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
