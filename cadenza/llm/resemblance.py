"""Resemblance: the Jaccard similarity of two texts' sets of five-word shingles, for near-duplicates that fingerprints
are too coarse for.

At similarity 0.8 about ten of a SimHash's 64 bits differ; anchors that wide would each hold most of all texts. So
``simhash.deduplicate`` confirms by whole sets what anchors bring together, and completes it here: a text's 120
min-hashes are taken in 24 bands of five, and two texts of similarity s share a band with probability
1 - (1 - s^5)^24: 0.9999 at 0.8, and more above. Candidate pairs are confirmed by the whole sets, unless confirmed
pairs connect them already: first each text of a bucket with the bucket's least, then those that are still apart. So
a cluster of near copies costs in proportion to its size; only texts that share a band without being connected are
compared with each other, inside a task that holds them. Where these are very many (texts that share a passage, say),
they meet again in their rarest shingles alone, of which two texts at the threshold share one: what they all have in
common brings none of them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SEED, SHINGLE, LEAST = 42, 5, 0.8
BANDS, ROWS = 24, 5
#: Shingles that are hashed 120 times at once.
AT_ONCE = 512
#: Texts that one task compares with another; more are dealt out, that one being copied. Texts that a task holds to
#: compare a bucket's others with; larger buckets are taken apart by their texts' rarest shingles, and only where those
#: too are shared by more, several tasks hold a part each.
MOST_OTHERS, MOST_HELD = 20_000, 2_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, words as in ``simhash.fingerprint``."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def key_of(words: list[bytes]) -> int:
    """What texts of equal words share (XXH64)."""
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included (fewer words: the whole sequence; none: nothing)."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return np.frombuffer(digest(b" ".join(words), SEED), ">u8").astype(np.uint64)
    data = b"".join([digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(shingle)))])
    return np.frombuffer(data, ">u8").astype(np.uint64)


@cache
def multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS + ROWS, dtype=np.uint64) | np.uint64(1)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A number per band, equal for texts with equal min-hashes there (no shingles: no bands)."""
    if not len(hashes):
        return np.empty(0, np.int64)
    by, mix = multipliers()[: BANDS * ROWS, None], multipliers()[BANDS * ROWS :]
    least = (by * hashes[None, :AT_ONCE]).min(axis=1)
    for a in range(AT_ONCE, len(hashes), AT_ONCE):
        np.minimum(least, (by * hashes[None, a : a + AT_ONCE]).min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    x = (least.reshape(BANDS, ROWS) * mix).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * mix[0]
    return ((x ^ (x >> np.uint64(32))) * mix[1]).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 if their sizes alone keep it below ``least``."""
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def with_key(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: the key of the column ``text``, which is left out if its name starts with two underscores."""
    keep = [c for c in rows.columns if c != text or not text.startswith("__")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.text_slices(batch, text):
                keys = np.array([key_of(words_of(x)) for x in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(keys)], names=[*keep, out])

    return rows.mapInArrow(run, rows.select(*keep).schema.add(out, "long"))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The ``pairs`` (a, b: keys) whose texts (key, text) are of similarity ``least`` or more. Both are read more than
    once: hand over stored tables."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MOST_OTHERS).cast("long").alias("parts"))
    own = texts.join(parts, texts["key"] == parts["a"]).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    others = pairs.join(parts, "a").join(texts, F.col("b") == texts["key"]).select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(1).alias("kind"), "b", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.uint64)
        for batch in batches:
            for part, found in common.text_slices(batch, "text"):
                a, b = [], []
                for x, kind, y, text in zip(part.column("a").to_pylist(), part.column("kind").to_pylist(), part.column("b").to_pylist(), found):
                    own = np.unique(shingles(words_of(text), shingle))
                    if kind == 0:
                        held = own
                    elif similarity(held, own, least) >= least - 1e-9:
                        a.append(x)
                        b.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = own.union(others).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return rows.mapInArrow(compare, "a long, b long")


def confirmed_within(apart: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST, most_held: int = MOST_HELD) -> DataFrame:
    """Edges (a, b) of keys that connect what is similar within the buckets of ``apart`` (bucket, key, root; roots say what
    is connected already). Texts: (key, text). Pairs are compared inside tasks and never become rows."""
    parts = apart.groupBy("bucket").agg(F.ceil(F.count("*") / most_held).cast("long").alias("parts"))
    rows = apart.join(parts, "bucket").withColumn("home", F.pmod(F.xxhash64("key"), "parts"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumn("kind", F.when(F.col("home") == F.col("part"), 0).otherwise(1)).join(texts, "key")
    rows = rows.select("bucket", "part", "kind", "key", "root", "text").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple = ()
        held: list[tuple[int, int, np.ndarray]] = []
        over: dict[int, int] = {}  # a root that has been connected to another one here

        def find(x: int) -> int:
            while x in over:
                x = over[x]
            return x

        for batch in batches:
            for part, found in common.text_slices(batch, "text"):
                a, b = [], []
                for bucket, block, kind, key, root, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "part", "kind", "key", "root")), found):
                    if (bucket, block) != place:
                        place, held, over = (bucket, block), [], {}
                    own = np.unique(shingles(words_of(text), shingle))
                    for other, root_other, theirs in held:
                        # a pair of two blocks is compared in the block of its lesser key
                        if (kind == 0 or other < key) and (x := find(root)) != (y := find(root_other)) and similarity(own, theirs, least) >= least - 1e-9:
                            over[max(x, y)] = min(x, y)
                            a.append(key)
                            b.append(other)
                    if kind == 0:
                        held.append((key, root, own))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def crowded(members: DataFrame) -> DataFrame:
    """Of ``members`` (bucket, key: rows distinct) those of buckets with more than one, with ``pivot``, the bucket's least
    key. Least keys and counts are combined before the shuffle, and a large bucket's rows can be split in the join."""
    some = members.groupBy("bucket").agg(F.min("key").alias("pivot"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    return members.join(some, "bucket")


def still_apart(members: DataFrame) -> DataFrame:
    """Of ``members`` (bucket, key, root) those of buckets with more than one root."""
    some = members.groupBy("bucket").agg(F.min("root").alias("__low"), F.max("root").alias("__high")).filter("__low <> __high").select("bucket")
    return members.join(some, "bucket", "left_semi")


def by_pivots(members: DataFrame, texts: DataFrame, edges: DataFrame, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """``edges`` with what connects members (bucket, key, pivot: a stored table) to their buckets' pivots, and the members
    (bucket, key, root) that no edge connects with all others of their bucket, pivots left out."""
    roots, path = common.stored(connected_components(edges), "roots")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    first = members.filter("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    # what is connected needs no comparison
    first = first.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("not coalesce(root_a, a) = coalesce(root_b, b)").select("a", "b")
    first, pairs = common.stored(first, "pairs")
    edges = common.cut(edges.union(confirmed(first, texts, shingle, least)), "links")
    for done in (path, pairs):
        common.remove(done)
    roots = common.cut(connected_components(edges), "roots")
    found = members.join(roots, members["key"] == roots["node"], "left").select("bucket", "key", "pivot", F.coalesce("root", "key").alias("root"))
    # without the least, and what it has connected, there may be nothing left to compare
    apart = still_apart(still_apart(found).filter("key <> pivot").drop("pivot"))
    return edges, common.cut(apart, "apart")


def rare_members(apart: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(bucket, key): the rarest shingles of each of the keys of ``apart``, as many as two texts of similarity ``least``
    can't both do without: each such pair meets in one of them. Rare is what few of these texts hold."""
    keys = apart.select("key").distinct()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in common.text_slices(batch, "text"):
                for key, text in zip(part.column("key").to_pylist(), found):
                    own = np.unique(shingles(words_of(text), shingle)).view(np.int64)
                    rank = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key)), pa.array(np.full(len(own), rank)), pa.array(own)], names=["key", "most", "bucket"])

    rows = common.cut(texts.join(keys, "key", "left_semi").mapInArrow(explode, "key long, most long, bucket long"), "shingles")
    often = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    known = rows.join(often, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "bucket"))  # a text's shingles
    return known.withColumn("rank", rank).filter("rank <= most and n > 1").select("bucket", "key")


def links(members: DataFrame, texts: DataFrame, known: DataFrame | None = None, shingle: int = SHINGLE, least: float = LEAST, most_held: int = MOST_HELD) -> DataFrame:
    """Edges (a, b) of keys that connect what the candidate pairs of similarity ``least`` or more connect, with the
    ``known`` ones among them.

    ``members`` (bucket, key, pivot: see ``crowded``) has a row per key and band, ``texts`` (key, text) those that share
    a bucket. All are read more than once: hand over stored tables. Buckets of which more than ``most_held`` texts stay
    apart aren't compared whole: their texts meet again in their rarest shingles.
    """
    edges = known if known is not None else common.cut(members.sparkSession.createDataFrame([], "a long, b long"), "links")
    edges, apart = by_pivots(members, texts, edges, shingle, least)
    sizes = apart.groupBy("bucket").agg((F.count("*") > most_held).alias("large"))
    sized = apart.join(sizes, "bucket")
    found = common.cut(confirmed_within(sized.filter("not large").drop("large"), texts, shingle, least, most_held), "links")
    edges = edges.union(found)
    large = sized.filter("large").select("bucket", "key")
    if large.isEmpty():
        return edges
    rare = common.cut(crowded(rare_members(large, texts, shingle, least)), "members")
    edges, apart = by_pivots(rare, texts, common.cut(edges, "links"), shingle, least)
    return edges.union(common.cut(confirmed_within(apart, texts, shingle, least, most_held), "links"))
