"""Bounded samples of labelled documents, from which classifiers learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Every so manieth document (by crc32 of its id as text) is held out and never learnt from.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that is never learnt from (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Rows doc_id, text, label (0 or 1), weight, turn: up to ``per_class`` labelled documents of each class.

    They are those with the least hash of their id, outside the held-out fold; weight says how many labelled
    documents of the class each stands for, and turn (0 or 1) deals a class's documents out alternately. Null labels
    and ids are left out; a document labelled twice alike counts once, and of several rows of one id one text is
    taken (that of the least hash). The number of rows depends on ``per_class`` only, whatever the tables hold.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    rows = rows.filter(~held_out(F.col("doc_id"))).distinct()
    known = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows at most
    sample = None
    for value in (0, 1):
        own = rows.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        own = own.withColumn("weight", F.lit(known.get(value, 0) / max(1, min(per_class, known.get(value, 0)))))
        own = own.withColumn("turn", (F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1) % 2)
        sample = own if sample is None else sample.union(own)
    # two times per_class rows of numbers at most; copies of a row are one before the shuffle
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = found.groupBy("doc_id", "label", "weight", "turn").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return found.select("doc_id", F.col("t.text").alias("text"), "label", "weight", "turn")
