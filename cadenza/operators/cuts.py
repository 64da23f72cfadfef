"""Palettes as tables: weighted median cut and its refinement over colour histograms, for any number and size of frames.

``palette.build_palette`` makes one frame's palette in a task. Here a frame's histogram is rows (frame, r, g, b, n), and all
frames' boxes are halved at once in each round, by sums in order within a box: 2**rounds colours at most. Then each
colour goes to the nearest of its frame's centres, which are so few that a row can hold them, and centres move to means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the squared differences of red, green and blue (fixed values).
SCALE = {"r": 2, "g": 3, "b": 1}
#: Rounds at most: 256 colours.
MOST_ROUNDS = 8


def histogram(pixels: DataFrame, frame: str, weight: str | None = None) -> DataFrame:
    """frame, r, g, b, n (long) of pixel rows (frame, r, g, b, a): how many solid ones have a colour, or the sum of their
    ``weight``; colours without weight are left out."""
    n = F.sum(F.col(weight).cast("long")) if weight else F.count(F.lit(1))
    return pixels.filter("a >= 128").groupBy(frame, *(F.col(c).cast("long").alias(c) for c in "rgb")).agg(n.alias("n")).filter("n > 0")


def median_cut(colours: DataFrame, frame: str, rounds: int) -> DataFrame:
    """``colours`` (see ``histogram``) with ``box`` (long): each round halves each box at the median of the weights along its
    widest channel (the first of equals of r, g, b). A box of one colour isn't halved. Each round is one shuffle by
    (frame, box), and no frame is larger in a task than its boxes are."""
    if not 0 <= rounds <= MOST_ROUNDS:
        raise ValueError("a palette has 1 to 256 colours")
    boxes = colours.withColumn("box", F.lit(0).cast("long"))
    for _ in range(rounds):
        box = Window.partitionBy(frame, "box")
        spread = lambda c: (F.max(c).over(box) - F.min(c).over(box)) * (F.max(c).over(box) - F.min(c).over(box)) * SCALE[c]  # noqa: B023, E731
        boxes = boxes.withColumns({f"__{c}": spread(c) for c in "rgb"} | {"__total": F.sum("n").over(box)})
        along = F.when((F.col("__r") >= F.col("__g")) & (F.col("__r") >= F.col("__b")), F.col("r")).when(F.col("__g") >= F.col("__b"), F.col("g")).otherwise(F.col("b"))
        boxes = boxes.withColumn("__along", along)
        before = F.sum("n").over(box.orderBy("__along", "r", "g", "b").rowsBetween(Window.unboundedPreceding, -1))
        upper = F.coalesce(2 * before, F.lit(0)) >= F.col("__total")
        boxes = boxes.withColumn("box", 2 * F.col("box") + upper.cast("long")).drop("__r", "__g", "__b", "__total", "__along")
    return boxes


def centres(boxes: DataFrame, frame: str) -> DataFrame:
    """frame, box, r, g, b (rounded means, halves up) and n of each box."""
    mean = lambda c: F.floor((2 * F.sum(F.col("n") * F.col(c)) + F.sum("n")) / (2 * F.sum("n"))).cast("long").alias(c)
    return boxes.groupBy(frame, "box").agg(*map(mean, "rgb"), F.sum("n").alias("n"))


def assigned(colours: DataFrame, table: DataFrame, frame: str) -> DataFrame:
    """``colours`` with the ``box`` of the nearest of their frame's centres (the least of equals) and its distance ``off``. A
    frame's centres, 2**MOST_ROUNDS at most, are one row."""
    held = table.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct("box", "r", "g", "b"))).alias("__table"))
    gap = lambda t: sum((k * (F.col(c) - t[c]) * (F.col(c) - t[c]) for c, k in SCALE.items()), F.lit(0))
    best = F.array_min(F.transform("__table", lambda t: F.struct(gap(t).alias("off"), t["box"].alias("box"))))
    rows = colours.select(frame, "r", "g", "b", "n").join(held, frame).withColumn("__best", best)
    return rows.select(frame, "r", "g", "b", "n", F.col("__best.box").alias("box"), F.col("__best.off").alias("off"))


def palettes(colours: DataFrame, frame: str, rounds: int, refinements: int = 1) -> DataFrame:
    """A palette of 2**rounds colours at most per frame: frame, box, r, g, b, n."""
    found = centres(median_cut(colours, frame, rounds), frame)
    for _ in range(refinements):
        found = centres(assigned(colours, found, frame), frame)
    return found
