"""Packing of tokenised documents into windows by minimum bin slack.

Token counts, not texts, decide the packing. Documents are cut into windows and a remainder, and a remainder
of over half a window at its half, so that no length, however common, is hard to complete. The histogram of
piece lengths (at most ``capacity`` rows, whatever the input) goes to the driver, which plans windows: the
longest remaining piece opens a window, and a bitset subset-sum picks from the remaining lengths the multiset
that leaves least slack. A plan step is repeated as often as the counts allow, so the plan too is bounded by
the window, not by the input. Spark then gives each piece its place: the rank among pieces of its length says
which repetition of which step holds it.

Pieces of one length may be any share of the rows (copies, full windows), so ranks are counted per
length and salt, and the salts' first ranks come from a small table of counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, tokens

CAPACITY = 1024
#: Salts of a length at least, and pieces per salt at most, were all of one length; bounds the groups in which ranks are counted.
LEAST_SALTS, ROWS_PER_SALT = 64, 200_000


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Of ``counts`` (length: how many), a multiset whose sum is as near to ``room`` as can be, not above it.

    Bit s of ``sums`` says that sum s can be reached. A length's copies are added in groups of 1, 2, 4, ...;
    the bits before each group are kept, and the way back through them gives the counts.
    """
    mask, sums = (1 << room + 1) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left > 0:
            n = min(group, left)
            steps.append((length, n, sums))
            sums |= (sums << n * length) & mask
            left, group = left - n, group * 2
        if sums >> room & 1:
            break
    best, chosen = sums.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            best -= n * length
            chosen[length] = chosen.get(length, 0) + n
    return chosen


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Windows as (multiset of lengths, repetitions), which use up the histogram exactly."""
    left = {k: n for k, n in histogram.items() if n > 0}
    plan = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        window = fill(capacity - seed, {k: n for k, n in rest.items() if n})
        window[seed] = window.get(seed, 0) + 1
        times = min(left[k] // n for k, n in window.items())
        plan.append((window, times))
        for k, n in window.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def plan_slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, in order of rank: (first rank, pieces per window, first window, first offset)."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for window, times in plan:
        offset = 0
        for length in sorted(window, reverse=True):
            n = window[length]
            slots.setdefault(length, []).append((used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None) -> DataFrame:
    """Give every row its window. ``pieces`` has ``length`` (long, 1 to ``capacity``) and any other columns.

    Returns the columns of ``pieces`` and ``sequence_id`` and ``offset`` (long): windows are numbered from 0
    without holes, and the pieces of a window lie one after another from offset 0. ``order`` names the columns
    by which pieces of equal length are ranked (default: all); rows equal in them are interchangeable.
    ``pieces`` is read twice: hand over a stored table. Columns of these names in the input are replaced.
    No rows: no windows. A length that is null or outside 1..capacity is an error.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    order = order or pieces.columns
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    if any(k is None or not 1 <= k <= capacity for k in histogram):
        raise ValueError("a piece's length must be 1 to the capacity")
    total = sum(histogram.values())
    if not total:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    slots = plan_slots(plan_windows(histogram, capacity))
    salts = max(LEAST_SALTS, -(-total // ROWS_PER_SALT))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    w = Window.partitionBy("length").orderBy("__salt")
    first = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    first = first.withColumn("__first", F.sum("__n").over(w) - F.col("__n")).drop("__n")
    local = Window.partitionBy("length", "__salt").orderBy(*order)
    ranked = (
        salted.withColumn("__rank", F.row_number().over(local) - 1)
        .join(first, ["length", "__salt"])
        .withColumn("__rank", (F.col("__first") + F.col("__rank")).cast("long"))
        .select(*pieces.columns, "__rank")
    )
    plan = spark.sparkContext.broadcast({k: tuple(np.array(x, dtype=np.int64).T) for k, x in slots.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            window, offset = np.empty_like(rank), np.empty_like(rank)
            by = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[by])) + 1
            for at in np.split(by, cuts) if len(by) else []:
                ranks, per, seq, off = plan.value[int(length[at[0]])]
                k = np.searchsorted(ranks, rank[at], side="right") - 1
                n = rank[at] - ranks[k]
                window[at], offset[at] = seq[k] + n // per[k], off[k] + n % per[k] * length[at]
            names = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(window), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = StructType([*pieces.schema]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Where a document of n tokens is cut."""
    last = n // capacity * capacity
    cuts = [*range(0, last + 1, capacity), *([last + capacity // 2] if n - last > capacity // 2 else []), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, byte_level: bool = True, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as token pieces of at most ``capacity``: full windows and a remainder (in two if over half a window).

    Null text is empty; ``end_id`` follows each document's ids, so each has a piece at least. Returns doc_id,
    start, length (long), ids_crc32 (long; of the ids as little-endian unsigned 32-bit), doc_tokens (long), place
    (long: the document's number in its part of the input) and, if asked for, ``ids`` (binary). Other input columns
    are left behind. A null id stays null.
    """
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {common.sql_type(rows, 'doc_id')}, start long, length long, ids_crc32 long, doc_tokens long, place long" + ", ids binary" * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = tokens.encoder(tokenizer, byte_level), 0
        for batch in batches:
            for part, texts in common.text_slices(batch, "text"):
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, data in enumerate(encode(texts)):
                    data += end
                    n = len(data) // 4
                    for a, b in piece_bounds(n, capacity):
                        own = data[4 * a : 4 * b]
                        row.append(i)
                        start.append(a)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        total.append(n)
                        if with_ids:
                            ids.append(own)
                arrays = [part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                arrays.append(pa.array([before + i for i in row], pa.int64()))
                before += part.num_rows
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(cut_up, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, byte_level: bool = True, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents; a row per piece (see ``tokenised_pieces`` and ``pack``).

    Pieces are stored once in the shared folder, so texts are tokenised once. Their places deal out rows that are
    equal in all else.
    """
    pieces = common.cut(tokenised_pieces(docs, tokenizer, end_id, capacity, byte_level, with_ids), "pieces")
    return pack(pieces, capacity, ["doc_id", "start", "ids_crc32", "doc_tokens", "place"]).drop("place")


def sequences(packed: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The windows themselves, from packed pieces with ``ids``: sequence_id, n_tokens, ids (array of int).

    A window shorter than ``capacity`` is padded with ``pad_id`` to it, unless its length is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(F.transform(parts, lambda x: F.hex(x["ids"])), F.lit(""), lambda a, x: F.concat(a, x)).alias("hex"))
    n = F.length("hex") / 8
    ids = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.conv(F.concat(*(F.substring(F.col("hex"), i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1))), 16, 10).cast("int"))
    short = F.col("n_tokens").cast("long").bitwiseAND(F.col("n_tokens").cast("long") - 1) != 0
    padding = F.array_repeat(F.lit(pad_id), F.when(short, F.lit(capacity) - F.col("n_tokens")).otherwise(F.lit(0)).cast("int"))
    return rows.select("sequence_id", "n_tokens", F.concat(ids, padding).alias("ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in windows of 1024 tokens (id 0 ends a document)."""
    docs = common.table(spark, sf_dir, "documents")
    return pack_documents(docs, tokens.public_path("byte_bpe_50k.json"), end_id=0)
