"""Compression classifier: a text is like the labelled texts whose zstandard dictionary shortens it more.

Two dictionaries are built, from good and from bad labelled texts. A text's evidence is the difference of its
compressed sizes under the two, normalised by its length; how that turns into a probability also depends on
how far the text can be compressed at all (text that only repeats itself needs no dictionary) and on its
length. A small ridge logistic regression over these three, fitted on labelled texts that the dictionaries
did not see, gives the calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labelled import held_out, labelled_sample

#: Labelled documents of each class to learn from, and pieces of them that make a dictionary, whatever the input's size.
PER_CLASS, PIECES = 8_000, 12_000
DICTIONARY_BYTES, LEVEL, PIECE = 65_536, 3, 2_000
REJECT_BELOW = 0.3
RIDGE = 1.0


@dataclass
class Model:
    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class Compressors:
    """Both dictionaries, ready for use."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for data in (good, bad):
            own = zstandard.ZstdCompressionDict(data) if data else None
            if own:
                own.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: normalised size difference (positive: like good ones), log of the compressed share, log length."""
        data = [x.encode("utf-8", "surrogatepass") for x in texts]
        good, bad = (np.array([len(c.compress(x)) for x in data], dtype=np.float64) for c in self.both)
        n = np.array([len(x) for x in data], dtype=np.float64) + 16
        return np.stack([(bad - good) / n, np.log(np.minimum(good, bad) + 8) - np.log(n), np.log(n)], axis=1)


def expand(features: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    d, r, n = np.clip((features - centre) / scale, -4, 4).T
    return np.stack([np.ones_like(d), d, r, n, d * d, r * r, n * n, d * r, d * n, r * n], axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ridge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weighted logistic regression by Newton's method with step halving."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
        if abs(size * step).max() < 1e-8:
            break
    return w


def build_dictionary(pieces: list[bytes]) -> bytes:
    """A zstandard dictionary of pieces of text; too few of them serve as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def calibrate(features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """centre, scale and weights of the regression."""
    centre, scale = np.median(features, axis=0), features.std(axis=0) + 1e-9
    return centre, scale, fit_ridge(expand(features, centre, scale), label.astype(np.float64), weight / weight.mean())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, pieces: int = PIECES) -> Model:
    """Learn from a bounded number of the labelled documents (see ``labelled_sample``).

    Every second document of a class goes into its dictionary, by up to ``pieces`` pieces of PIECE bytes that are drawn
    by hash from the whole texts; the rest, whole, calibrate (all of them do if there is no other). No labels at all, or
    of one class only, give a model all the same: it scores by the class's share.
    """
    sample = common.cut(labelled_sample(docs, labels, label, per_class), "labelled")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.text_slices(batch, "text"):
                for own, text in zip(part.column("label").to_pylist(), texts):
                    data = text.encode("utf-8", "surrogatepass")
                    found = [data[a : a + PIECE] for a in range(0, len(data), PIECE)]
                    order = [xxhash.xxh3_64_intdigest(x) >> 1 for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.int32()), pa.array(order, pa.int64()), pa.array(found, pa.binary())], names=["label", "order", "piece"])

    cuts = sample.filter("turn = 0").mapInArrow(cut_up, "label int, order long, piece binary")
    chosen = [cuts.filter(F.col("label") == k).orderBy("order", "piece").limit(pieces) for k in (0, 1)]  # PIECES times PIECE bytes each

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {0: [], 1: []}
        for batch in batches:
            for k, x in zip(batch.column("label").to_pylist(), batch.column("piece").to_pylist()):
                held[k].append(x)
        yield pa.RecordBatch.from_arrays([pa.array([build_dictionary(held[k])], pa.binary()) for k in (1, 0)], names=["good", "bad"])

    both = chosen[0].union(chosen[1]).repartition(1).sortWithinPartitions("label", "order", "piece").mapInArrow(train, "good binary, bad binary").collect()
    good, bad = (bytes(both[0][k]) for k in ("good", "bad")) if both else (b"", b"")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.text_slices(batch, "text"):
                found = compressors(good, bad).features(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "label", "weight", "turn")), *map(pa.array, found.T)], names=["doc_id", "label", "weight", "turn", "d", "r", "n"])

    kind = f"doc_id {common.sql_type(sample, 'doc_id')}, label int, weight double, turn int, d double, r double, n double"
    rows = sample.mapInArrow(measure, kind).orderBy("label", "doc_id").toPandas()  # numbers of two times per_class rows at most
    rest = rows[rows["turn"] == 1] if (rows["turn"] == 1).any() else rows
    if not len(rest):
        return Model(good, bad, np.zeros(3), np.ones(3), np.zeros(10))
    return Model(good, bad, *calibrate(rest[["d", "r", "n"]].to_numpy(), rest["label"].to_numpy(), rest["weight"].to_numpy()))


_ready: dict[tuple[bytes, bytes], Compressors] = {}


def compressors(good: bytes, bad: bytes) -> Compressors:
    """This process's compressors of two dictionaries."""
    if (good, bad) not in _ready:
        _ready.clear()
        _ready[good, bad] = Compressors(good, bad)
    return _ready[good, bad]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (default: all) and ``score`` (double, 0 to 1: how likely label 1 is) of every whole text.

    Null text is empty, and empty texts have the score of their length. A column named score is replaced. One row
    per input row, no shuffle.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    rows = docs.select(*carried, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES and 16 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in common.text_slices(batch, "__text"):
                scores = logistic(expand(compressors(m.good, m.bad).features(texts), m.centre, m.scale) @ m.weights)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(scores)], names=[*carried, "score"])

    return rows.mapInArrow(run, docs.select(*carried).schema.add("score", "double"))


def filter_documents(docs: DataFrame, model: Model, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows that score at least ``reject_below``, with the input's columns."""
    if "score" in docs.columns:
        return filter_documents(docs.withColumnRenamed("score", "__own_score"), model, reject_below).withColumnRenamed("__own_score", "score").select(*docs.columns)
    return score(docs, model).filter(F.col("score") >= reject_below).select(*docs.columns)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))
