"""Repetition coverage: how much of a text lies inside repeated n-grams and repeated lines.

Texts are judged one by one, many at a time: the words of a slice of rows lie in one numpy array of 64-bit
word hashes, and a rolling hash of every n-gram length is taken over it (a polynomial modulo 2**64, one
multiply-add per added word). The document's number is mixed into the hash, so one sort per length finds the
n-grams that recur within their own text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile("[^ \t-\r]+")
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BASE_N, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Odd multipliers modulo 2**64: one for the rolling hash, one that spreads document numbers.
ROLL, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MOST_KNOWN, MARK_BITS = 400_000, 22


@dataclass(frozen=True)
class Limits:
    """Most that a kept text may have. Shares are of the characters in words, 0 to 1.

    duplicate_ngrams: n-gram length to the share of characters inside n-grams found before in the text.
    top_ngrams: n-gram length to the share that the most frequent n-gram covers, if it comes twice at least.
    The shares leave alone a short text that opens and closes with the same line.
    """

    duplicate_ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20})
    top_ngrams: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    duplicate_lines: float = 0.30
    symbols_per_word: float = 0.10
    line_min_words: int = 20


def words_of(text: str) -> list[str]:
    """Runs of characters other than the six of BLANK."""
    # split() cuts at other white space too
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


def dense_codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words, by way of those met before."""
    if len(known) > MOST_KNOWN:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def covered(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in an n-gram that starts at one of ``first``."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + n, -1)
    return np.cumsum(change[:-1]) > 0


def ngram_groups(rolled: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-grams that recur within their own text, sorted so that equal ones are together in ascending
    order, and which of them begins a group."""
    starts = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, np.int64)
    key = (rolled[starts] ^ (rolled[starts] >> np.uint64(31))) * ROLL + (doc[starts].astype(np.uint64) + np.uint64(1)) * SPREAD
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return starts[:0], np.empty(0, dtype=bool)
    marked = np.zeros(1 << MARK_BITS, dtype=bool)  # most others are told by their first bits
    shift = np.uint64(64 - MARK_BITS)
    marked[twice >> shift] = True
    maybe = marked[key >> shift]
    starts, key = starts[maybe], key[maybe]
    again = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
    starts, key = starts[again], key[again]
    by = np.argsort(key, kind="stable")
    starts, key = starts[by], key[by]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    return starts, fresh


def measure(texts: list[str], limits: Limits, known: dict[str, int]) -> dict[str, np.ndarray]:
    """The figures of every text (see ``measure_documents``)."""
    rows = len(texts)
    words: list[str] = []
    counts = np.zeros(rows, dtype=np.int64)
    out = {k: np.zeros(rows, dtype=np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines")}
    line_chars = np.zeros(rows)
    for i, text in enumerate(texts):
        own = words_of(text)
        words += own
        counts[i] = len(own)
        out["word_chars"][i] = len(text) - sum(map(text.count, BLANK))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        if "\n" in text:
            seen: set[str] = set()
            for line in text.split("\n"):
                if line.strip(BLANK):
                    if line in seen:
                        out["n_dup_lines"][i] += 1
                        line_chars[i] += len(line) - sum(map(line.count, BLANK))
                    seen.add(line)
    out["n_words"] = counts
    doc = np.repeat(np.arange(rows), counts)
    size = len(words)
    length = np.fromiter(map(len, words), np.int64, size)
    chars = np.maximum(out["word_chars"], 1.0)
    codes = dense_codes(words, known)
    out["n_repeat_words"] = np.zeros(rows, dtype=np.int64)
    excess = np.zeros(rows)
    rolled = codes.copy()
    for n in range(2, max([BASE_N, *limits.duplicate_ngrams, *limits.top_ngrams]) + 1):
        if size < n:
            break
        rolled = rolled[:-1] * ROLL + codes[n - 1 :]
        if n != BASE_N and n not in limits.duplicate_ngrams and n not in limits.top_ngrams:
            continue
        starts, fresh = ngram_groups(rolled, doc, n)
        if not len(starts):
            continue
        if n == BASE_N:
            twice = ~fresh
            twice[:-1] |= ~fresh[1:]
            out["n_repeat_words"] = np.bincount(doc, weights=covered(starts[twice], n, size), minlength=rows).astype(np.int64)
        if n in limits.duplicate_ngrams:
            share = np.bincount(doc, weights=length * covered(starts[~fresh], n, size), minlength=rows) / chars
            excess = np.maximum(excess, share / limits.duplicate_ngrams[n])
        if n in limits.top_ngrams:
            head = np.flatnonzero(fresh)
            times = np.diff(np.append(head, len(starts)))
            first = starts[head]
            sums = np.concatenate([[0], np.cumsum(length)])
            covers = np.where(times > 1, times * (sums[first + n] - sums[first]), 0)
            share = np.zeros(rows)
            np.maximum.at(share, doc[first], covers)
            excess = np.maximum(excess, np.where(counts > 0, share / chars, 0) / limits.top_ngrams[n] * (counts >= limits.line_min_words))
    line_share = line_chars / np.maximum(out["word_chars"], 1)
    out["repetition"] = np.maximum(excess, line_share / limits.duplicate_lines)
    out["symbols"] = out["n_symbols"] / np.maximum(counts, 1) / limits.symbols_per_word
    out["base_failed"] = (counts < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * counts)
    out["kept"] = ~out["base_failed"] & (out["repetition"] <= 1) & (out["symbols"] <= 1)
    return out


FIGURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "repetition": "double", "symbols": "double"}
_known: dict[str, int] = {}


def measure_documents(docs: DataFrame, limits: Limits | None = None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Figures and verdict of every whole text.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and return.
    n_words; word_chars (code points in words); n_symbols (characters of ``#*$%&|<>``); n_dup_lines (lines with a
    word that equal an earlier line); n_repeat_words (words in 8-word windows found twice or more in the text);
    base_failed (under 20 words, or over 30 in 100 of them repeated); repetition and symbols (the largest share
    over its limit, 1 being at it); kept (not failed, and both at most 1). Null and empty texts have no words
    and fail. One row per input row: nothing is compared between rows, and there is no shuffle. Columns ``keep``
    (default: all) are carried along; one that bears a figure's name is replaced.
    """
    limits = limits or Limits()
    carried = [c for c in (docs.columns if keep is None else keep) if c not in FIGURES]
    rows = docs.select(*carried, F.col(text_col).alias("__text"))
    schema = docs.select(*carried).schema
    for name, kind in FIGURES.items():
        schema = schema.add(name, kind)
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.text_slices(batch, "__text"):
                found = measure(texts, limits, _known)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *(pa.array(found[k], kinds[t]) for k, t in FIGURES.items())], names=[*carried, *FIGURES])

    return rows.mapInArrow(figures, schema)


def filter_documents(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows that the rules keep, with the input's columns."""
    if clash := [c for c in docs.columns if c in FIGURES]:
        names = {c: f"__own_{c}" for c in clash}
        return filter_documents(docs.withColumnsRenamed(names), limits).withColumnsRenamed({v: k for k, v in names.items()})
    return measure_documents(docs, limits).filter("kept").select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    return measure_documents(common.table(spark, sf_dir, "documents"), keep=["doc_id"])
