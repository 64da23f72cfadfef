"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are which hashed single words, words cut to their first letters, word pairs and pairs with
one or two words between occur in it. FTRL-proximal learns a weight per coordinate with its own learning rate; its
L1 term leaves most weights at exactly zero, so the model is a short list of (coordinate, weight) and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labelled import held_out, labelled_sample

BITS = 22
#: Labelled documents of each class to learn from, whatever the input's size.
PER_CLASS = 4_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.5, 5
#: The rarer class counts more, by this power of the classes' ratio.
BALANCE = 0.75
STEM = 5
#: Distances of the second word of a pair, and a multiplier for each (odd, modulo 2**64).
PAIRS = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 3: 0x165667B19E3779F9}
EDGES = ".,;:!?\"'()[]{}<>*#%&$|-"
MOST_KNOWN = 400_000


@dataclass
class Model:
    """Coordinates in ascending order, and their weights; coordinate 2**BITS is the intercept."""

    at: np.ndarray
    weight: np.ndarray


class Hashes:
    """64-bit hashes of lower-cased words without the punctuation at their ends, and of their first letters."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.stems: dict[str, int] = {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > MOST_KNOWN:
            self.words.clear()
            self.stems.clear()
        for w in set(words).difference(self.words):
            plain = w.lower().strip(EDGES) or w
            self.words[w] = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass"))
            self.stems[w] = xxhash.xxh64_intdigest(plain[:STEM].encode("utf-8", "surrogatepass"), 1)
        return tuple(np.fromiter(map(x.__getitem__, words), np.uint64, len(words)) for x in (self.words, self.stems))


def features(texts: list[str], hashes: Hashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kind by kind: (text number, coordinate) of every occurrence."""
    split = [x.split() for x in texts]
    row = np.repeat(np.arange(len(texts)), [len(x) for x in split])
    h, stems = hashes([w for x in split for w in x])
    shift = np.uint64(64 - BITS)
    yield row, (h >> shift).astype(np.int64)
    yield row, (stems >> shift).astype(np.int64)
    for d, m in PAIRS.items():
        if len(h) > d:
            same = row[:-d] == row[d:]
            yield row[:-d][same], ((h[:-d] * np.uint64(m) + h[d:]) * np.uint64(PAIRS[1]) >> shift).astype(np.int64)[same]


def coordinates(text: str, hashes: Hashes) -> np.ndarray:
    """A text's distinct coordinates in ascending order, and the intercept's."""
    return np.append(np.unique(np.concatenate([c for _, c in features([text], hashes)])), 1 << BITS)


def balance(mass: dict[int, float]) -> dict[int, float]:
    """How much a row of each class counts, beside its own weight; ``mass`` is the classes' total weight."""
    if len(mass) < 2 or min(mass.values()) <= 0:
        return dict.fromkeys((0, 1), 1.0)
    rare = min(mass, key=mass.get)
    return {k: (max(mass.values()) / mass[k]) ** BALANCE if k == rare else 1.0 for k in mass}


def learn(examples: Iterator[tuple[np.ndarray, int, float]]) -> Model:
    """FTRL-proximal over a stream of (coordinates, label, weight); nothing but the two numbers of a coordinate is kept."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        shrink = np.where(i == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z[i]) <= shrink, 0.0, -(z[i] - np.sign(z[i]) * shrink) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for i, label, weight in examples:
        w = weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = weight * (p - label)
        rate = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
        z[i] += g - rate * w
        n[i] += g * g
    at = np.flatnonzero(n)
    w = weights(at)
    return Model(at[w != 0], w[w != 0].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from a bounded number of the labelled documents (see ``labelled_sample``), whole texts of any length.

    Tasks turn texts into coordinates; one task then streams these, EPOCHS times in an order of its own each time.
    No labels: an empty model, which scores 0.5.
    """

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.text_slices(batch, "text"):
                at = pa.array([coordinates(x, _hashes) for x in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "label", "weight")), at], names=["doc_id", "label", "weight", "at"])

    sample = labelled_sample(docs, labels, label, per_class)
    rows = common.cut(sample.mapInArrow(prepare, f"doc_id {common.sql_type(sample, 'doc_id')}, label int, weight double, at array<int>"), "examples")
    mass = {r[0]: (r[1], r[2]) for r in rows.groupBy("label").agg(F.sum("weight"), F.count("*")).collect()}  # two rows at most
    if not mass:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32))
    more = balance({k: m for k, (m, _) in mass.items()})
    mean = sum(m * more[k] for k, (m, _) in mass.items()) / sum(c for _, c in mass.values())
    turns = rows.withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS))))).repartition(1)
    turns = turns.sortWithinPartitions("epoch", F.xxhash64("epoch", "doc_id"), "doc_id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[tuple[np.ndarray, int, float]]:
            for batch in batches:
                for at, y, w in zip(batch.column("at"), batch.column("label").to_pylist(), batch.column("weight").to_pylist()):
                    yield at.values.to_numpy(), y, w * more[y] / mean

        m = learn(examples())
        yield pa.RecordBatch.from_arrays([pa.array([m.at], pa.list_(pa.int64())), pa.array([m.weight], pa.list_(pa.float32()))], names=["at", "weight"])

    found = turns.select("label", "weight", "at").mapInArrow(run, "at array<long>, weight array<float>").collect()
    return Model(np.array(found[0]["at"], np.int64), np.array(found[0]["weight"], np.float32))


_hashes = Hashes()


def score_texts(texts: list[str], table: np.ndarray, hashes: Hashes) -> np.ndarray:
    """Probabilities; ``table`` holds all weights by coordinate."""
    total = np.full(len(texts), float(table[-1]))
    for row, at in features(texts, hashes):
        hit = np.flatnonzero(table[at])  # few: most weights are zero
        pair = np.unique(row[hit] << BITS | at[hit])
        total += np.bincount(pair >> BITS, weights=table[pair & (1 << BITS) - 1], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (default: all) and ``score`` (double, 0 to 1: how likely label 1 is) of every whole text.

    Null and empty texts have no features: their score is the intercept's. A column named score is replaced. One
    row per input row, no shuffle.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    rows = docs.select(*carried, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights, far fewer by L1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) + 1, dtype=np.float32)
        table[shared.value.at] = shared.value.weight
        for batch in batches:
            for part, texts in common.text_slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(score_texts(texts, table, _hashes))], names=[*carried, "score"])

    return rows.mapInArrow(run, docs.select(*carried).schema.add("score", "double"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
