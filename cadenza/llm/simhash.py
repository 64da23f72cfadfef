"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code: the product of two binary Golay codes of length 23 over 46 of
the 64 bits. Each Golay code is perfect with covering radius 3, so a fingerprint has one home anchor. If two
fingerprints differ in at most t bits, the second is no more than 3 + e1 and 3 + e2 bits from the first one's
home in the two halves, with e1 + e2 <= t. So every distinct fingerprint is replicated to the anchors within
covering radius plus threshold in that sense (61 on average for t = 2, of 2**24 anchors), and at each anchor
those at home there are compared with all that came, on the whole 64 bits.

Equal fingerprints are one before that. At an anchor, homes lie first and are held (a bounded number; anchors
with more are split by salt, their visitors being copied to each part), and visitors stream past. Links leave
a task as spanning edges of what is connected there, not as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, resemblance
from .components import connected_components

SEED, SHINGLE, THRESHOLD = 42, 3, 2
#: The generator polynomial of the Golay code (fixed value), its length and covering radius.
GOLAY, LENGTH, RADIUS = 0b110001110101, 23, 3
#: Homes of an anchor that a task holds; at most so many anchors can have more.
MOST_HOMES, MOST_SPLIT_ANCHORS = 20_000, 10_000
#: Homes up to which visitors are compared with each; above it their neighbours are looked up instead.
FEW_HOMES = 256
PAIRS_AT_ONCE = 1_000_000
#: Places of texts (16 bytes and a key each) that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def bits_of(data: bytes) -> int:
    """The fingerprint of hashes of eight bytes each: a bit is 1 if it is in over half of them (none: 0)."""
    n = len(data) // 8
    bits = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 65_536):
        rows = np.frombuffer(data, np.uint8)[8 * a : 8 * (a + 65_536)].reshape(-1, 8)
        bits += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text (null: empty).

    A-Z are lower-cased; words are runs of characters other than space and \\t\\n\\v\\f\\r; shingles are of
    ``shingle`` words joined by a space, repeats included (fewer words: the whole sequence; none: 0). A bit is 1
    if it is in over half of the shingles' XXH64 (seed 42).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    digest = xxhash.xxh64_digest
    return bits_of(b"".join([digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(shingle)))]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``fp`` (long: the 64 bits as a signed number) of each row; other columns are left behind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.text_slices(batch, "text"):
                fps = np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(make, f"doc_id {common.sql_type(rows, 'doc_id')}, fp long")


class Anchors:
    """The covering code's anchors near a fingerprint."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        unit = []
        for i in range(LENGTH):
            x = 1 << i
            for k in range(LENGTH - 1, 10, -1):
                if x >> k & 1:
                    x ^= GOLAY << k - 11
            unit.append(x)
        table = np.zeros(1, dtype=np.int64)
        for s in unit[:12]:
            table = np.concatenate([table, table ^ s])
        self.low = table
        table = np.zeros(1, dtype=np.int64)
        for s in unit[12:]:
            table = np.concatenate([table, table ^ s])
        self.high = table
        #: By excess over the covering radius: error patterns in order of syndrome, and where a syndrome's begin.
        self.errors, self.begin, self.count = [], [], []
        for excess in range(threshold + 1):
            weights = range(RADIUS + 1) if not excess else (RADIUS + excess,)
            patterns = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(LENGTH), w)], dtype=np.int64)
            syndrome = self.syndrome(patterns)
            by = np.argsort(syndrome, kind="stable")
            self.errors.append(patterns[by])
            self.count.append(np.bincount(syndrome, minlength=2048))
            self.begin.append(np.concatenate([[0], np.cumsum(self.count[-1])[:-1]]))

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFF] ^ self.high[x >> 12]

    @staticmethod
    def halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = (1 << LENGTH) - 1
        return fps & mask, fps >> LENGTH & mask

    def home(self, fps: np.ndarray) -> np.ndarray:
        a, b = (x ^ self.errors[0][self.begin[0][self.syndrome(x)]] for x in self.halves(fps))
        return a << LENGTH | b

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (number of the fingerprint, anchor) for all anchors that a fingerprint is replicated to; its home is one."""
        a, b = self.halves(fps)
        sa, sb = self.syndrome(a), self.syndrome(b)
        rows, anchors = [], []
        for ea in range(self.threshold + 1):
            for eb in range(self.threshold + 1 - ea):
                na, nb = self.count[ea][sa], self.count[eb][sb]
                each = na * nb
                row = np.repeat(np.arange(len(fps)), each)
                k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                i, j = k // nb[row], k % nb[row]
                ca = a[row] ^ self.errors[ea][self.begin[ea][sa[row]] + i]
                cb = b[row] ^ self.errors[eb][self.begin[eb][sb[row]] + j]
                rows.append(row)
                anchors.append(ca << LENGTH | cb)
        return np.concatenate(rows), np.concatenate(anchors)


@cache
def anchors_for(threshold: int) -> Anchors:
    return Anchors(threshold)


@cache
def flips(threshold: int) -> np.ndarray:
    """All masks of 1 to ``threshold`` bits."""
    return np.array([sum(1 << i for i in c) for w in range(1, threshold + 1) for c in combinations(range(64), w)], dtype=np.uint64)


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect, one fewer than a component has nodes."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def compare_sorted(batches: Iterator[tuple[np.ndarray, np.ndarray]], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows (key, fp) in order of key, whose lowest bit is 0 for a home and whose rest names the anchor."""
    place = np.empty(0, dtype=np.int64)
    held = np.empty(0, dtype=np.uint64)  # homes of the anchor that the last batch ended in
    last = -1
    for key, fp in batches:
        if not len(key):
            continue
        anchor, home = key >> 1, key & 1 == 0
        if anchor[0] != last:
            held = held[:0]
        kept = len(held)
        place = np.concatenate([np.full(kept, last, dtype=np.int64), anchor])
        value = np.concatenate([held, fp])
        is_home = np.concatenate([np.ones(kept, dtype=bool), home])
        begin = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        size = np.diff(np.append(begin, len(place)))
        homes = np.add.reduceat(is_home.astype(np.int64), begin)
        visitor = np.arange(len(place)) >= kept
        found_a, found_b = [], []
        per = np.repeat(np.where((homes <= FEW_HOMES) & (size > 1), homes, 0), size) * visitor
        first = np.repeat(begin, size)
        rows = np.flatnonzero(per)
        blocks = np.cumsum(per[rows]) // PAIRS_AT_ONCE
        for some in np.split(rows, np.flatnonzero(np.diff(blocks)) + 1) if len(rows) else []:
            n = per[some]
            row = np.repeat(some, n)
            other = np.repeat(first[some], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            link = (np.bitwise_count(value[row] ^ value[other]) <= threshold) & (value[row] != value[other])
            found_a.append(value[row[link]])
            found_b.append(value[other[link]])
        for s in np.flatnonzero(homes > FEW_HOMES):
            own = np.sort(value[begin[s] : begin[s] + homes[s]])
            visitors = value[max(begin[s], kept) : begin[s] + size[s]]
            masks = flips(threshold)
            step = max(1, PAIRS_AT_ONCE // len(masks))
            for k in range(0, len(visitors), step):
                v = visitors[k : k + step]
                near = v[:, None] ^ masks[None, :]
                at = np.minimum(np.searchsorted(own, near), len(own) - 1)
                i, j = np.nonzero(own[at] == near)
                found_a.append(v[i])
                found_b.append(near[i, j])
        if found_a:
            yield spanning_edges(np.concatenate(found_a), np.concatenate(found_b))
        end = begin[-1]
        last, held = int(place[end]), value[end : end + homes[-1]]


def links(distinct: DataFrame, threshold: int = THRESHOLD, most_homes: int = MOST_HOMES) -> DataFrame:
    """Edges (a, b) that connect exactly the values of ``distinct`` (column fp: distinct longs, no null) that differ
    in at most ``threshold`` bits, directly or through others. ``distinct`` is read twice: hand over a stored table."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anchors_for(threshold).home(batch.column("fp").to_numpy()))], names=["anchor"])

    homes = distinct.select("fp").mapInArrow(home, "anchor long").groupBy("anchor").count()
    most = max(most_homes, distinct.count() // MOST_SPLIT_ANCHORS)
    split = {r["anchor"]: min(65_535, -(-r["count"] // most)) for r in homes.filter(F.col("count") > most).collect()}  # at most MOST_SPLIT_ANCHORS rows

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = anchors_for(threshold)
        crowded = np.array(sorted(split), dtype=np.int64)
        parts = np.array([split[x] for x in crowded.tolist()], dtype=np.int64)
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            own = code.home(fps)
            row, anchor = code.near(fps)
            key = anchor << 17 | (anchor != own[row])
            if len(crowded):
                at = np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)
                n = np.where(crowded[at] == anchor, parts[at], 1)
                salt = (fps[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % n
                copies = np.repeat(np.arange(len(key)), n)
                part = np.arange(len(copies)) - np.repeat(np.cumsum(n) - n, n)
                # in its own part a home is a home, in the others a visitor
                at_home = (key[copies] & 1 == 0) & (salt[copies] == part)
                key, row = anchor[copies] << 17 | part << 1 | ~at_home, row[copies]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)) for b in batches)
        for a, b in compare_sorted(rows, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    near = distinct.select("fp").mapInArrow(replicate, "key long, fp long")
    near = near.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return near.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the least doc_id of the rows whose
    fingerprints are linked, directly or through others) and n_same (rows of equal fingerprint).

    Null and empty texts have fingerprint 0, linked like any other. Rows of equal id are rows of their own; a null
    id stays null and never names a component unless all of its ids are null. Other columns are left behind.
    """
    marked = common.cut(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = common.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")), "classes")
    roots = common.cut(connected_components(links(classes, threshold)), "roots")
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "n_same", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(named, "root").select("fp", "component_id", "n_same")
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")


def with_place(docs: DataFrame) -> DataFrame:
    """``docs`` with __file and __row (long), which tell every row from all others and are the same at each reading: where
    it lies in its file. What doesn't come straight from files is stored first."""
    place = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").cast("long").alias("__row")]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return common.cut(docs, "documents").select("*", *place)


def deduplicate(docs: DataFrame, shingle: int = resemblance.SHINGLE, least: float = resemblance.LEAST, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Of each component of similar texts one row, whole and with the input's columns: that of the least id.

    Two texts are similar whose sets of ``shingle`` words have a Jaccard similarity of ``least`` or more; texts of equal
    words are alike, null and empty ones too. Fingerprints of those shingles go to anchors, and what differs there in
    at most ``threshold`` bits is confirmed by the whole sets; pairs that no anchor can bring together are found by
    min-hash bands (``resemblance``), where what anchors have connected is passed over. Ids compare before words,
    null ids last, and of rows equal in both that stays which lies first in its file. The row that stays is known by
    its place, so however often an id or a text occurs, nothing gathers at it. ``docs`` is read three times.
    """
    names = docs.columns
    docs = with_place(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "__file", "__row")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.text_slices(batch, "text"):
                words = [resemblance.words_of(x) for x in texts]
                hashes = [resemblance.shingles(x, shingle) for x in words]
                keys, fps = ([f(x) for x in own] for f, own in ((resemblance.key_of, words), (lambda h: bits_of(h.astype(">u8").tobytes()), hashes)))
                columns = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (keys, fps)]
                bands = pa.array([resemblance.bands_of(h) for h in hashes], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "__file", "__row")), *columns, bands], names=["doc_id", "file", "row", "key", "fp", "bands"])

    kind = common.sql_type(rows, "doc_id")
    marked = rows.mapInArrow(make, f"doc_id {kind}, file long, row long, key long, fp long, bands array<long>")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "file", "row")
    classes = common.cut(marked.groupBy("key").agg(F.min(first).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")

    # fingerprints that anchors connect, as pairs of texts: each with the least of its fingerprint, and these with each other
    heads = common.cut(classes.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    same = classes.join(heads, "fp").filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    near = links(heads.select("fp"), threshold)
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("head_a")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("head_b")), "b")
    pairs = common.cut(same.union(near.select("head_a", "head_b")).distinct(), "pairs")

    # whole texts are fetched only of those that meet another one
    members = common.cut(resemblance.crowded(classes.select(F.explode("bands").alias("bucket"), "key")), "members")
    wanted = members.select("key").union(pairs.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    wanted = common.cut(classes.join(wanted, "key", "left_semi").select("key", "least.file", "least.row"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= most_broadcast else wanted
    texts = common.cut(rows.join(wanted, (F.col("__file") == F.col("file")) & (F.col("__row") == F.col("row"))).select("key", "text"), "texts")

    edges = common.cut(resemblance.confirmed(pairs, texts, shingle, least), "links")
    roots = common.cut(connected_components(resemblance.links(members, texts, edges, shingle, least)), "roots")
    named = classes.select("key", "least").join(roots, classes["key"] == roots["node"], "left").select("least", F.coalesce("root", "key").alias("root"))
    stay = named.groupBy("root").agg(F.min("least").alias("w")).select(F.col("w.file").alias("__stay_file"), F.col("w.row").alias("__stay_row"))
    kept = docs.join(stay, (F.col("__file") == F.col("__stay_file")) & (F.col("__row") == F.col("__stay_row")), "left_semi")
    return kept.select(*names)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
