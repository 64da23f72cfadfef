"""Byte-level BPE by a pair occurrence index.

The distinct words of a block of a partition lie end to end in one array of symbols. An index maps each
adjacent pair that the vocabulary can merge to all its positions. Ranks that have positions are applied in
ascending order, each at all its positions at once; every merge enters the pairs that it makes into their
lists. Since a word is merged by its own lowest rank first whatever other words do, the result is what
merging word by word gives. Positions whose pair has gone meanwhile are dropped when their list is read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Bytes of distinct words that are merged at once; bounds the arrays and the index.
BLOCK_BYTES = 2_000_000
#: Bytes of remembered words in each of two generations.
MOST_BYTES = 90_000_000


def merge_order(position: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of ascending positions of one pair, which to merge: of overlapping ones every second, from the left.

    ``follows`` says that a position's second symbol is the next position's first.
    """
    if not follows.any():
        return np.ones(len(position), dtype=bool)
    n = np.arange(len(position))
    starts = np.concatenate([[True], ~follows[:-1]])
    return (n - np.maximum.accumulate(np.where(starts, n, 0))) % 2 == 0


class PairIndexBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, symbols = spec["model"], tokens.byte_symbols()
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or model["end_of_word_suffix"] or model["continuing_subword_prefix"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer or affixes is needed")
        vocab = model["vocab"]
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.byte_ids = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [b"%d," % i for i in range(size)]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.left, self.right, self.size = left, right, size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.pattern = regex.compile(tokens.PATTERN)
        self.known = tokens.Remembered(lambda unit: self.encode_words([unit])[0], MOST_BYTES)  # filled many at once

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by one pair occurrence index over all of them."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lengths.sum())
        if not n:
            return [np.empty(0, np.int64) for _ in words]
        symbol = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(lengths)
        after = np.arange(1, n + 1)
        after[ends[lengths > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[(ends - lengths)[lengths > 0]] = -1
        alive = np.ones(n, dtype=bool)

        first = np.flatnonzero(after >= 0)
        ranks = self.rank(symbol[first], symbol[first + 1])
        first, ranks = first[ranks >= 0], ranks[ranks >= 0]
        by = np.argsort(ranks, kind="stable")
        cuts = np.flatnonzero(np.diff(ranks[by])) + 1
        index: dict[int, list[np.ndarray]] = {int(ranks[x[0]]): [first[x]] for x in np.split(by, cuts) if len(x)}
        active = list(index)
        heapq.heapify(active)

        def enter(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions into their lists."""
            found = self.rank(symbol[at], symbol[after[at]])
            at, found = at[found >= 0], found[found >= 0]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(found, kind="stable")
                at, found = at[order], found[order]
                cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(at)]
            else:
                cuts = [0, 1]
            for a, b in zip(cuts, cuts[1:]):
                r = int(found[a])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[a:b])

        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbol[at] == a)]
            nxt = after[at]
            ok = (nxt >= 0) & (symbol[nxt] == b)
            at = at[ok]
            if len(at) > 1:
                at = np.unique(at)
                if a == b:
                    follows = np.zeros(len(at), dtype=bool)
                    follows[:-1] = after[at[:-1]] == at[1:]
                    at = at[merge_order(at, follows)]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[r]
            alive[gone] = False
            beyond = after[gone]
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            previous = before[at]
            previous = previous[previous >= 0]
            enter(np.concatenate([previous, at[inner]]))

        counts = np.add.reduceat(alive, (ends - lengths)[lengths > 0]) if n else []
        per = np.zeros(len(words), dtype=np.int64)
        per[lengths > 0] = counts
        return np.split(symbol[alive], np.cumsum(per)[:-1])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian u32 bytes) of texts that hold no special token."""
        parts = [[p.encode() for p in self.pattern.findall(w)] for w in words]
        distinct = list(dict.fromkeys(p for x in parts for p in x))
        ids: dict[bytes, bytes] = {}
        start = held = 0
        for i, p in enumerate(distinct):
            held += len(p)
            if held >= BLOCK_BYTES or i + 1 == len(distinct):
                some = distinct[start : i + 1]
                ids.update(zip(some, (x.astype("<u4").tobytes() for x in self.merge(some))))
                start, held = i + 1, 0
        return [b"".join([ids[p] for p in x]) for x in parts]

    def words(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian u32 bytes) of texts: those of their units, of which the new ones are merged together."""
        # white space that only Python takes for such may stand anywhere in a unit's end, so those texts stay whole
        whole = [any(s in x for s in self.specials) or any(c in x for c in tokens.ODD_SPACE) for x in texts]
        units = [None if w else tokens.UNIT.findall(x) for x, w in zip(texts, whole)]
        missing = set().union(*filter(None, units))
        got = {u: known[u] for known in (self.known, self.known.older) for u in missing.intersection(known.keys())}
        new = list(missing.difference(self.known.keys()))
        unmet = [u for u in new if u not in got]
        got.update(zip(unmet, self.encode_words(unmet)))
        for unit in new:
            if len(unit) <= tokens.LONGEST_UNIT:
                self.known.remember(unit, got[unit])
        return [self._encode_around_specials(x) if us is None else b"".join(map(got.__getitem__, us)) for x, us in zip(texts, units)]

    def _encode_around_specials(self, text: str) -> bytes:
        parts = self.split_specials.split(text) if self.split_specials else [text]
        plain = [p for p in parts if p and p not in self.specials]
        ids = dict(zip(plain, self.encode_words(plain)))
        return b"".join(np.uint32(self.specials[p]).tobytes() if p in self.specials else ids[p] for p in parts if p)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.words(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_models: dict[str, PairIndexBpe] = {}


def model(path: str) -> PairIndexBpe:
    """This process's model of a vocabulary file."""
    if path not in _models:
        _models[path] = PairIndexBpe(path)
    return _models[path]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (binary: little-endian unsigned 32-bit) of every whole text; null text is empty and has
    no ids. One row per input row, repeated rows included; other columns are left behind. No shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for batch in batches:
            for part, texts in common.text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bpe.words(texts), pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(encode, f"doc_id {common.sql_type(rows, 'doc_id')}, ids binary")


def digest_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Of ``encode_documents``' rows: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the text that the ids decode to). A null ``ids`` counts as none."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for data in batch.column("ids"):
                ids = np.frombuffer(data.as_py() or b"", "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b"".join(map(bpe.decimal.__getitem__, ids))[:-1]).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(digest, f"doc_id {common.sql_type(encoded, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    path = tokens.public_path("byte_bpe_50k.json")
    return digest_documents(encode_documents(common.table(spark, sf_dir, "documents"), path), path)
