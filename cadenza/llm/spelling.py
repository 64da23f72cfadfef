"""Spelling variants: words one edit apart, and the frequent word that a rare one stands for.

Words within one inserted, deleted or replaced code point are found from the edits themselves: each word's
deletions and replacements are looked up in Bloom filters of the vocabulary, one per length, whose blocks are 512 bits.
An insertion is the other word's deletion, and a replacement is tried towards the greater letter only, so each pair
is generated once. What a filter lets pass is joined with the vocabulary, which removes what was passed by chance.

Hashes are sums over a word's positions, so that an edit's hash is the word's with a few terms exchanged, and no
edited word is written out before a filter passes it. Filters are built by a grouped OR per block and broadcast; if
all together are beyond ``MOST_BROADCAST`` bytes, shards of them are broadcast in turn and the words probed again.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters of words; texts' A-Z are lower-cased before.
LETTERS = "a-zÀ-ÿ"
#: Code points and occurrences of a word at least; how many times as frequent a form is at least.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in so many loses a code point.
EVERY = 199
#: Words of a filter's block of 512 bits; bits that a word sets.
BLOCK_WORDS, BITS = 32, 6
#: Bytes of filters that are broadcast at once.
MOST_BROADCAST = 64_000_000
#: Words that a task counts before it hands them on; characters whose runs are listed at once; probes of a step.
HELD_WORDS, AT_ONCE, STEP = 400_000, 1_000_000, 2_000_000
_LANES = [f"l{k}" for k in range(8)]


def counted(docs: DataFrame, id_col: str, text_col: str, every: int, least_length: int) -> DataFrame:
    """word, n: occurrences in all texts, after the deletions, of words of ``least_length`` code points or more."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # a shorter run is no word before or after a deletion

    def of_text(text: str) -> Iterator[Counter]:
        low = text.encode().lower().decode()  # A-Z alone
        if len(low) <= AT_ONCE:
            yield Counter(runs.findall(low))
            return
        found = (m.group() for m in runs.finditer(low))
        while some := Counter(islice(found, 100_000)):
            yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part, texts in common.text_slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), texts):
                    before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for some in of_text(text):
                        for word, n in some.items():
                            h = zlib.crc32(word.encode(), before)
                            if not h % every:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                            held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield handed_on()
        yield handed_on()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (wrapping)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def term(position: int, letters: np.ndarray) -> np.ndarray:
    """What a letter (its code point, under 256) at a position adds to its word's hash."""
    return mixed(letters.astype(np.uint64) | np.uint64(position << 8))


def word_hashes(letters: np.ndarray) -> np.ndarray:
    """Of words of one length (a matrix of code points), their hashes."""
    h = np.zeros(len(letters), dtype=np.uint64)
    for i in range(letters.shape[1]):
        h += term(i, letters[:, i])
    return h


def blocks_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def bit_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th bit's place in the block, 0 to 511."""
    return (mixed(hashes) >> np.uint64(9 * k + 4)) & np.uint64(511)


def passes(lanes: np.ndarray, first: int, blocks: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold: its ``blocks`` blocks in all, of which ``lanes`` are those from ``first`` on."""
    block = blocks_of(hashes, blocks)
    at = np.flatnonzero((block >= first) & (block < first + len(lanes) // 8)) if first or len(lanes) < 8 * blocks else np.arange(len(hashes))
    block = (block[at] - np.uint64(first)) * np.uint64(8)
    scrambled = mixed(hashes[at])
    for k in range(BITS):
        bit = (scrambled >> np.uint64(9 * k + 4)) & np.uint64(511)
        hit = (lanes[block + (bit >> np.uint64(6))] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        at, block, scrambled = at[hit], block[hit], scrambled[hit]
    return at


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in ``words``, matrix of code points), for each length and bounded numbers of words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        step = max(1, 4_000_000 // max(1, size))
        for k in range(0, len(own), step):
            some = own[k : k + step]
            yield size, some, np.frombuffer("".join([words[i] for i in some]).encode("latin-1"), np.uint8).reshape(len(some), size)


def filter_blocks(vocabulary: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """size, block, l0 to l7 (long): the filters of words by length, a row per block that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, letters in by_length(batch.column("word").to_pylist()):
                h = word_hashes(letters)
                lanes = np.zeros((8, len(h)), dtype=np.uint64)
                for k in range(BITS):
                    bit = bit_of(h, k)
                    lanes[bit >> np.uint64(6), np.arange(len(h))] |= np.uint64(1) << (bit & np.uint64(63))
                arrays = [pa.array(np.full(len(h), size, np.int32)), pa.array(blocks_of(h, blocks[size]).astype(np.int64)), *(pa.array(x.view(np.int64)) for x in lanes)]
                yield pa.RecordBatch.from_arrays(arrays, names=["size", "block", *_LANES])

    rows = vocabulary.select("word").mapInArrow(run, "size int, block long, " + ", ".join(f"{x} long" for x in _LANES))
    return rows.groupBy("size", "block").agg(*(F.bit_or(x).alias(x) for x in _LANES))


def shards(blocks: dict[int, int], most: int) -> list[list[tuple[int, int, int]]]:
    """Rounds of (length, first block, end), each of at most ``most`` bytes of filters."""
    rounds: list[list[tuple[int, int, int]]] = [[]]
    per, room = max(1, most // 64), max(1, most // 64)
    for size in sorted(blocks):
        first = 0
        while first < blocks[size]:
            if not room:
                rounds.append([])
                room = per
            end = min(blocks[size], first + room)
            rounds[-1].append((size, first, end))
            room -= end - first
            first = end
    return [x for x in rounds if x]


def neighbourhoods(words: list[str], filters: dict[int, list[tuple[int, np.ndarray]]], blocks: dict[int, int], alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places in ``words``, edited words) that the filters let pass: deletions and replacements by a greater letter."""
    for size, own, letters in by_length(words):
        text = [words[i] for i in own]
        some = filters.get(size, [])
        fewer = filters.get(size - 1, [])
        if not some and not fewer:
            continue
        whole = word_hashes(letters)
        before = np.zeros(len(own), dtype=np.uint64)
        after = np.zeros(len(own), dtype=np.uint64)
        for i in range(1, size):
            after += term(i - 1, letters[:, i])
        step = max(1, STEP // len(alphabet))
        for i in range(size):
            here = term(i, letters[:, i])
            if fewer:  # of equal letters in a row, one is deleted
                at = np.flatnonzero(letters[:, i] != letters[:, i - 1]) if i else np.arange(len(own))
                h = (before + after)[at]
                for first, lanes in fewer:
                    hit = at[passes(lanes, first, blocks[size - 1], h)]
                    if len(hit):
                        yield own[hit], [text[k][:i] + text[k][i + 1 :] for k in hit.tolist()]
            if some:
                base, terms = whole - here, term(i, alphabet)
                for k in range(0, len(own), step):
                    row, letter = np.nonzero(alphabet[None, :] > letters[k : k + step, i, None])
                    h = base[k + row] + terms[letter]
                    for first, lanes in some:
                        hit = passes(lanes, first, blocks[size], h)
                        if len(hit):
                            at = k + row[hit]
                            yield own[at], [text[a][:i] + chr(c) + text[a][i + 1 :] for a, c in zip(at.tolist(), alphabet[letter[hit]].tolist())]
            before += here
            if i + 1 < size:
                after -= term(i, letters[:, i + 1])


def near_pairs(vocabulary: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """word, n, near, near_n: every pair of the vocabulary (a stored table of distinct ``word`` and ``n``, words of
    letters under U+0100) that differs by one edit, once, in one direction or the other."""
    spark = vocabulary.sparkSession
    counts = {r[0]: r[1] for r in vocabulary.groupBy(F.length("word")).count().collect()}  # a row per length
    blocks = {size: -(-n // BLOCK_WORDS) for size, n in counts.items()}
    letters = [r[0] for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()]  # letters of an alphabet
    alphabet = np.array(sorted(map(ord, letters)), dtype=np.uint8)
    rows = common.cut(filter_blocks(vocabulary, blocks), "filters")
    found = None
    for shard in shards(blocks, most_broadcast):
        filters: dict[int, list[tuple[int, np.ndarray]]] = {}
        for size, first, end in shard:
            table = rows.filter((F.col("size") == size) & (F.col("block") >= first) & (F.col("block") < end)).select("block", *_LANES).toArrow()
            lanes = np.zeros((end - first, 8), dtype=np.uint64)
            at = table.column("block").to_numpy() - first
            for k, x in enumerate(_LANES):
                lanes[at, k] = table.column(x).to_numpy().view(np.uint64)
            filters.setdefault(size, []).append((first, lanes.reshape(-1)))
        sent = spark.sparkContext.broadcast(filters)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, edited in neighbourhoods(batch.column("word").to_pylist(), sent.value, blocks, alphabet):
                    own = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([own.column("word"), own.column("n"), pa.array(edited, pa.string())], names=["word", "n", "near"])

        probed = common.cut(vocabulary.repartition(F.xxhash64("word")).select("word", "n").mapInArrow(run, "word string, n long, near string"), "probes")
        found = probed if found is None else found.union(probed)
        sent.unpersist()
    exact = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    if found is None:
        return vocabulary.limit(0).withColumns({"near": F.col("word"), "near_n": F.col("n")})
    return found.join(exact, "near").select("word", "n", "near", "near_n")


def followed(forms: DataFrame) -> DataFrame:
    """word, root for word, form (words distinct, no cycles): forms followed to the last, in rounds that double the way."""
    links = common.cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        beyond = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = common.cut(links.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The vocabulary of whole texts, and the form of each word.

    Words are maximal runs of a-z, A-Z (lower-cased) and U+00C0 to U+00FF. A run whose h, the crc32 of
    ``<id>:<run>``, is divisible by ``every`` loses its code point h % length; results of at least ``least_length`` code
    points and ``least_count`` occurrences are words. Returns word, form (its near word of largest n, of equal ones the
    least by code points, if that n is at least ``times`` the word's), root (forms followed to the last; the word itself
    if it has none), n, n_near (words one edit apart; 0 if none), form_n (the form's n). A null text has no words; a
    null id is written as nothing. Equal rows each count; other columns are left behind.
    """
    words = counted(docs, id_col, text_col, every, least_length).filter(F.col("n") >= least_count)
    words = common.cut(words, "words")
    pairs = near_pairs(words, most_broadcast)
    both = pairs.select("word", "n", "near", "near_n").union(pairs.select(F.col("near"), F.col("near_n"), F.col("word"), F.col("n")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    fits = -F.col("best.m") >= times * F.col("n")
    best = common.cut(best.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "variants")
    roots = followed(best.filter("form is not null"))
    found = words.join(best, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words and forms."""
    return group_variants(common.table(spark, sf_dir, "documents"))
