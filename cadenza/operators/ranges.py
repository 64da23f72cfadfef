"""Ranges that hold other ranges: for each request the newest earlier one whose range holds its own, without a limit.

Requests of a key are ordered by time and cut into blocks. Inside a block all are held against all. What finds nothing
there looks in earlier blocks by divide and conquer: at each level of a binary tree over a key's blocks, right halves
ask left halves. That an asked range begins no later is a sort; that it ends no sooner is told by the dyadic intervals
of ends that lie above; so one question is the largest position up to a place in an order, a running maximum, which
``scan.running`` cuts into blocks again. A request asks log(blocks) x log(ends) times at most, and no group is large.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources import shared

from .scan import BLOCK, POS, in_blocks, running

#: Requests that are held against each other at once.
BLOCK_ROWS = 512


def newest_holding(requests: DataFrame, keys: Sequence[str], order: Sequence[str], request: str, low: str, high: str, out: str = "reused", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``requests`` with ``out``: the ``request`` of the last one before (equal ``keys``, in ``order``) whose range, both ends
    included, holds the own one; null if there is none. A null end of a range is open: a range of two nulls is the
    whole clip and holds all."""
    number = lambda c, none: F.coalesce(F.col(c).cast("double"), F.lit(none))
    rows = in_blocks(requests.withColumns({"__low": number(low, float("-inf")), "__high": number(high, float("inf"))}), keys, order, block_rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            """The finished blocks, the last one being held back."""
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            names = [k for k in table.schema.names if k.startswith("__k")] + [BLOCK]
            edge = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
            for c in names:
                codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                edge |= codes[1:] != codes[:-1]
            cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), table.num_rows]
            held.clear()
            for a, b in zip(cuts, cuts[1:]):
                part = table.slice(a, b - a)
                if b == table.num_rows and batch is not None:
                    held.extend(part.to_batches())
                else:
                    yield part

        def found_in(part: pa.Table) -> tuple[np.ndarray, ...]:
            pos, lo, hi = (part.column(c).to_numpy() for c in (POS, "__low", "__high"))
            holds = (lo[None, :] <= lo[:, None]) & (hi[None, :] >= hi[:, None])  # [i, j]: j holds i
            before = np.tril(holds, -1)
            any_, last = before.any(axis=1), len(pos) - 1 - before[:, ::-1].argmax(axis=1)
            outlived = np.triu(holds, 1).any(axis=1)  # a newer one holds it: it answers nothing that this one doesn't
            return pos, np.where(any_, pos[last], -1), ~outlived

        def answered(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
            found = [*map(found_in, parts)]
            if found:
                pos, own, lasts = map(np.concatenate, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(own, mask=own < 0), pa.array(lasts)], names=[POS, "__own", "__lasts"])

        for batch in batches:
            yield from answered(blocks(batch))
        yield from answered(blocks(None))

    own_keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    named = [f"__k{i}" for i in range(len(keys))]
    bare = rows.select(*own_keys, BLOCK, POS, "__low", "__high")
    local = bare.repartition(*named, BLOCK).sortWithinPartitions(*named, BLOCK, POS).mapInArrow(compare, f"{POS} long, __own long, __lasts boolean")
    local = shared.stored(local.withColumnRenamed(POS, "__at"), "ranges")

    # only keys of several blocks go on: what asks, and what may answer
    numbers = bare.select(*(F.col(c).alias(f"{c}n") for c in named), F.col(BLOCK).alias("__b")).distinct()
    of_key = Window.partitionBy(*(f"{c}n" for c in named))
    numbers = numbers.withColumns({"__nr": F.row_number().over(of_key.orderBy("__b")) - 1, "__n": F.count("*").over(of_key)}).filter("__n > 1")
    same = F.col(BLOCK) == F.col("__b")
    for c in named:
        same &= F.col(c).eqNullSafe(F.col(f"{c}n"))
    answers = local.select("__at", F.col("__own").alias("__found"))
    if not numbers.isEmpty():
        several = bare.join(numbers, same).select(*named, F.col(POS).alias("__at"), "__low", "__high", "__nr").join(local, "__at")
        asks, gives = several.filter("__own is null").withColumn("__kind", F.lit(1)), several.filter("__lasts").withColumn("__kind", F.lit(0))
        # of equal ends those that ask come first, so that what may answer lies above them
        ranked = running(in_blocks(asks.unionByName(gives), [], ["__high", F.desc("__kind"), "__at"]), [], {"__rank": ("sum", F.lit(1).cast("long"))})
        ranked = ranked.drop(POS, BLOCK)
        levels, ends = ranked.agg(F.max("__nr"), F.max("__rank")).first()
        node = f"explode(filter(sequence(0, {int(levels).bit_length() - 1}), l -> (shiftright(__nr, l) & 1) = __kind)) as __level"
        end = f"explode(filter(sequence(0, {int(ends).bit_length() - 1}), m -> (shiftright(__rank, m) & 1) = 1 - __kind)) as __size"
        spread = ranked.selectExpr(*named, "__at", "__low", "__kind", "__nr", "__rank", node).select("*", F.expr(end))
        spread = spread.withColumns({"__node": F.expr("shiftright(__nr, __level + 1)"), "__interval": F.expr("shiftright(__rank, __size) + __kind")})
        group = [*named, "__level", "__node", "__size", "__interval"]
        spread = spread.select(*group, "__low", "__kind", "__at")
        best = running(in_blocks(spread, group, ["__low", "__kind", "__at"]), group, {"__best": ("max", F.when(F.col("__kind") == 0, F.col("__at")))})
        best = best.filter("__kind = 1 and __best is not null").groupBy("__at").agg(F.max("__best").alias("__best"))
        answers = answers.join(best, "__at", "left").select("__at", F.coalesce("__found", "__best").alias("__found"))
    given = rows.select(F.col(POS).alias("__found"), F.col(request).alias(out))
    answers = answers.filter("__found is not null").join(given, "__found").select("__at", out)
    return rows.join(answers, F.col(POS) == F.col("__at"), "left").select(*requests.columns, out)
