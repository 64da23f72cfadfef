"""SpotSigs: a text's signatures are the chains of content words that follow its common words.

Everything here is DataFrame operations. At every anchor (a very common word) the next content words, however
many other anchors stand between, are hashed together with it; the set of these hashes is the fingerprint.
Frames, menus and lists hold few common words and so hardly count.

Two sets whose Jaccard likeness is at least t differ in size by a factor of 1/t at most. ``similar_texts``
therefore deals sets out by size, so that only neighbouring size classes meet; there, only sets that share one
of their rarest signatures are compared (of a set of n, the n - ceil(t n) + 1 rarest must hold one of the
other's), and of those only pairs whose sizes allow t.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the a an of and to in is was are be for that this with as by at on it from or than not but"
    " le la les de des du et un une en que qui pour dans par sur est au aux se pas"
    " der die das den dem des und von zu mit sich auf für ist im ein eine nicht auch"
    " el los las del y por para con una no su lo como más"
).split()
CHAIN = 2
SPLIT = r"[^\p{L}\p{N}]+"
#: Documents in a block of the order, about, in which each meets its next one.
BLOCK_ROWS, MOST_BLOCKS = 4_000, 10_000


def with_signatures(rows: DataFrame, text: str, out: str, anchors: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """``rows`` and ``out``: the sorted distinct signatures (array of int) of the column ``text``.

    A text without a complete chain has one signature, of all its words; one without words (empty, null) has none.
    """
    anchor = lambda x: x.isin(*(anchors or ANCHORS))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPLIT), lambda x: x != "")
    rows = rows.withColumn("__words", words)
    rows = rows.withColumns({
        "__content": F.filter("__words", lambda x: ~anchor(x)),
        "__spots": F.filter(F.transform("__words", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: anchor(s["x"])),
    })
    # the j-th anchor, at word i, has i - j content words before it
    complete = F.filter(F.transform("__spots", lambda s, j: F.struct(s["x"].alias("x"), (s["i"] - j).alias("c"))), lambda s: s["c"] + chain <= F.size("__content"))
    found = F.transform(complete, lambda s: F.hash(s["x"], *(F.get(F.col("__content"), s["c"] + k) for k in range(chain))))
    rows = rows.withColumn(out, F.array_sort(F.array_distinct(found)))
    alone = F.when(F.size("__words") > 0, F.array(F.hash("__words"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(alone)).drop("__words", "__content", "__spots")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sorted sets (0 to 1; equal sets, also empty ones: 1), counted only where the ranges of
    their values meet."""
    apart = (F.size(a) == 0) | (F.size(b) == 0) | (F.array_max(a) < F.array_min(b)) | (F.array_max(b) < F.array_min(a))
    both = F.size(F.array_intersect(a, b))
    return F.when(F.col(a) == F.col(b), 1.0).when(apart, 0.0).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def as_text(signatures: str) -> Column:
    """A set as text: eight hex digits for each signature, in order."""
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def number_above(key: Column, cuts: list[int]) -> Column:
    """How many of ``cuts`` (in falling order) are above a key, by two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    numbers = lambda x: F.array(*(F.lit(c).cast("long") for c in x))
    # a group whose last cut is above the key is above it as a whole
    whole = F.size(F.filter(numbers([g[-1] for g in groups]), lambda c: c > key))
    part = F.coalesce(F.get(F.array(*map(numbers, groups)), whole), F.array().cast("array<long>"))
    return F.least(whole * step, F.lit(len(cuts))) + F.size(F.filter(part, lambda c: c > key))


def with_next(rows: DataFrame, key: str, columns: list[str], tie: list[str]) -> DataFrame:
    """``rows`` with next_<column>: the columns' values in the row that follows in descending order of the long
    ``key`` (null last; ties in order of ``tie``); after the last comes the first.

    Quantiles of the key cut the order into blocks of about BLOCK_ROWS, each ordered on its own; a copy of each
    block's first row stands at the end of the block before. The rows are shuffled once.
    """
    rows = rows.withColumn("__key", F.coalesce(F.col(key), F.lit(-(1 << 63))))
    total = rows.count()
    blocks = min(MOST_BLOCKS, max(1, total // BLOCK_ROWS))
    cuts = rows.agg(F.approx_percentile("__key", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] if blocks > 1 else []
    cuts = sorted(set(cuts), reverse=True)  # MOST_BLOCKS numbers at most
    rows = rows.withColumn("__block", number_above(F.col("__key"), cuts))
    heads = sorted((r[0], r[1]) for r in rows.groupBy("__block").agg(F.max("__key")).collect())
    if not heads:
        return rows.select("*", *(F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns)).drop("__key", "__block")
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}
    pairs = [x for head, own in before.items() for x in (F.lit(head).cast("long"), F.lit(own))]
    copies = rows.filter(F.col("__key").isin(*before)).withColumn("__block", F.create_map(*pairs)[F.col("__key")])
    both = rows.withColumn("__copy", F.lit(False)).unionByName(copies.withColumn("__copy", F.lit(True)))
    w = Window.partitionBy("__block").orderBy("__copy", F.desc("__key"), *tie)
    found = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return found.filter("not __copy").drop("__key", "__block", "__copy")


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are; one row per input row.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document, in descending order of id. Null text is empty, a null id is last in that order; rows of equal id
    are in the order of their texts. Two empty sets are alike (1); an empty and another one are not (0). Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. No rows: none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(with_signatures(rows, "text", "own"), "doc_id", ["text", "own"], ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = with_signatures(rows, "edited", "other")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )


def similar_texts(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicates by signature sets: doc_id, class_id (the least doc_id reachable over links) and n_links (how many
    other distinct sets have a likeness of at least ``threshold`` to its own); one row per input row.

    Rows of equal sets are one before the comparison. Empty texts are alike. A null id stays null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = common.cut(with_signatures(rows, "text", "own").select("doc_id", F.sha2(F.array_join("own", ","), 256).alias("set"), "own"), "signatures")
    sets = common.cut(rows.groupBy("set").agg(F.first("own").alias("own"), F.min("doc_id").alias("least")), "sets")
    spread = sets.select("set", F.size("own").alias("n"), F.explode("own").alias("s"))
    rare = spread.groupBy("s").agg(F.count("*").alias("rows"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    order = Window.partitionBy("set").orderBy("rows", "s")
    spread = spread.join(rare.filter("rows > 1"), "s", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    # signatures that one set alone has count towards the prefix, but lead nowhere
    short = spread.withColumn("k", F.row_number().over(order)).filter((F.col("k") <= prefix) & (F.col("rows") > 1))
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)))
    short = short.select("set", "n", "s", step.alias("size_class"))
    left = short.select(F.col("set").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("size_class", F.col("size_class") + 1)).alias("size_class"))
    right = short.select(F.col("set").alias("b"), F.col("n").alias("nb"), "s", "size_class")
    allowed = (F.col("a") != F.col("b")) & (F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * F.lit(threshold) - 1e-9) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["s", "size_class"]).filter(allowed).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("set").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("set").alias("b"), F.col("own").alias("own_b")), "b")
    links = common.cut(pairs.filter(likeness("own_a", "own_b") >= threshold).select("a", "b"), "links")
    counts = links.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("n_links"))
    roots = connected_components(links)
    known = sets.select("set", "least").join(roots.withColumnsRenamed({"node": "set"}), "set", "left").join(counts, "set", "left")
    known = known.withColumn("root", F.coalesce("root", "set"))
    named = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(named, "root").select("set", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", "set").join(known, "set").select("doc_id", "class_id", "n_links")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return compare_with_edit(common.table(spark, sf_dir, "documents"))
