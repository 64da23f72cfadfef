"""Alignment of the tokens that two tokenizers give one text.

Spans come first: the ``tokenizers`` library's character offsets for one tokenizer, the spans of sentencepiece's
encoding proto for the other. Where a token's span ends and the next begins there, that is a cut. Tokens that share
one character (bytes of a character, byte-fallback tokens) have no cut between them; the bytes that they decode to
place them. Positions where tokens of both end cut a text into groups.

Neither tokenizer merges across a cut before white space that follows something else, or before a mark that follows a
letter (checked against the vocabulary), so a text is the sum of its units, a word with the white space before it,
and each distinct unit is encoded and aligned once in a while per worker. A block is some million characters of one task's rows. Its links are
counted per distinct pair before the shuffle; the corpus-wide counts come back to a block by a join, and only numbers
per pair, never texts, move.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Characters of text of a block: its units, pairs and documents' unit numbers are in memory at once.
BLOCK_CHARS = 8_000_000
#: What a row counts beside its characters.
ROW_CHARS = 100
#: Units that are remembered in each of two generations, and characters of text whose units are listed at once.
MOST_UNITS, AT_ONCE = 350_000, 1_000_000
#: White space as the byte-level pre-tokenizer sees it (fixed value).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and marks between which neither tokenizer merges.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-@\\[-`{-~"
#: Counts of a unit or document.
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: What stands for a unit that a tokenizer doesn't give back byte by byte.
BAD = (0, 0, 0, 0, None, b"")


def token_ends(start: np.ndarray, end: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens end, of texts that lie end to end. Coarse spans (bytes) cut where a token's ends and the next begins
    there; tokens whose spans are empty or overlap the next have no cut after them, and the ``size`` of what they decode
    to places them between the cuts. ``first`` says which tokens begin a text. Cuts that the sizes don't bear out don't
    count: sizes alone are right where they add up to the text."""
    n = len(size)
    known = np.cumsum(size)
    if not n:
        return known
    last = np.append(first[1:], True)
    cut = last | (start != end) & (end <= np.append(start[1:], 0))
    place = np.maximum.accumulate(np.where(cut, np.arange(n), -1))
    before = np.concatenate([[-1], place[:-1]])  # the last cut before a token
    at_cut = np.where(before >= 0, end[before], 0)
    refined = at_cut + known - np.where(before >= 0, known[before], 0)
    ends = np.where(cut, end, refined)
    return ends if (ends == known).all() else known


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ascending ends over the same bytes: every end of either, and the numbers of the A and the B token that hold the
    bytes before it. Each such pair overlaps, each overlapping pair is one of them; where both end, that is a cut."""
    every = np.union1d(a_ends, b_ends)
    return every, np.searchsorted(a_ends, every), np.searchsorted(b_ends, every)


class PairAligner:
    """Units aligned between a byte-level vocabulary of the ``tokenizers`` library (A) and a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = tokens.load(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # the strings of special tokens are plain text
        byte_of = {c: k for k, c in enumerate(tokens.byte_symbols())}
        self.a_bytes: dict[int, bytes] = {}
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size = np.zeros(1 + max(self.a_bytes), dtype=np.int64)
        self.a_size[[*self.a_bytes]] = [*map(len, self.a_bytes.values())]
        self.b_size = np.array([*map(len, self.b_bytes)], dtype=np.int64)
        self.text = [*map(str, range(max(len(self.a_size), len(self.b_size))))]
        # where some piece has white space after something else, or a mark after a letter, is no place for a cut
        plain = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        joined = "".join(sorted({m for p in plain for m in re.findall(f"(?<=[^{SPACE}])[{SPACE}]", p)}))
        if " " in joined or "\n" in joined or any("\n" in p or re.search(f"[{LETTERS}][{MARKS}]", p) for p in plain):
            raise ValueError("the model's pieces go beyond words")
        more = f"(?:[{re.escape(joined)}][{SPACE}]*(?:[^{SPACE}]+|\\Z))*" if joined else ""
        self.unit = re.compile(f"[{SPACE}]*[{LETTERS}]+(?=[{MARKS}])|[{SPACE}]*[^{SPACE}]+{more}|[{SPACE}]+")
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def tokens_of(self, units: list[str], texts: bytes, sizes: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """A's and B's tokens of the units, which lie end to end in ``texts``: ids, the units' numbers, and the coarse spans
        (starts, ends) in bytes."""
        at = np.cumsum(sizes) - sizes
        ours = self.a.encode_batch(units, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(x.ids for x in ours), np.int64)
        unit = np.repeat(np.arange(len(units)), [len(x) for x in ours])
        spans = np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable(x.offsets for x in ours)), np.int64).reshape(-1, 2)
        letters = np.append(np.flatnonzero((np.frombuffer(texts, np.uint8) & 0xC0) != 0x80), len(texts))  # where characters begin
        first = np.cumsum([0, *map(len, units[:-1])])[unit]
        a = ids, unit, letters[first + spans[:, 0]], letters[first + spans[:, 1]]

        # B writes a space before a text unless that is empty; nothing merges with a line's end
        spaced = np.array([u[0] == " " != u for u in units])
        theirs = self.b.encode([u[1:] if own else "\n" + u for u, own in zip(units, spaced.tolist())], num_threads=1, return_type="proto")
        found = [x.pieces for x in theirs]
        flat = np.array([v for x in found for p in x for v in (p.id, p.begin, p.end)], dtype=np.int64).reshape(-1, 3)
        counts = np.array([*map(len, found)])
        unit = np.repeat(np.arange(len(units)), counts)
        number = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
        own = spaced[unit]
        start = flat[:, 1] + np.where(own, number > 0, -1) + at[unit]
        end = flat[:, 2] + np.where(own, 1, -1) + at[unit]
        kept = own | (number > 1)
        return a, (flat[kept, 0], unit[kept], start[kept], end[kept])

    def align_units(self, units: list[str]) -> list[tuple]:
        """For each unit: n_a, n_b, n_groups, n_links, its groups as ``a1,a2|b1;...`` and its links as pairs of ids
        (little-endian u64: A's id in the upper half); ``BAD`` where a tokenizer's bytes aren't the unit's."""
        data = [u.encode() for u in units]
        sizes, whole = np.array([*map(len, data)]), b"".join(data)
        both = self.tokens_of(units, whole, sizes)
        good = np.ones(len(units), dtype=bool)
        for (ids, unit, _, _), of, size in zip(both, (self.a_bytes, self.b_bytes), (self.a_size, self.b_size)):
            pieces = [*map(of.__getitem__, ids.tolist())]
            if b"".join(pieces) != whole or (np.bincount(unit, size[ids], len(units)) != sizes).any():
                cuts = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
                good &= [b"".join(pieces[x:y]) == d for x, y, d in zip(cuts, cuts[1:], data)]
        if not good.all():  # the others alone
            some = iter(self.align_units([u for u, ok in zip(units, good) if ok]) if good.any() else ())
            return [next(some) if ok else BAD for ok in good]
        (a_ids, a_unit, *a_spans), (b_ids, b_unit, *b_spans) = both
        begins = lambda unit: np.append(True, unit[1:] != unit[:-1])[: len(unit)]
        a_ends = token_ends(*a_spans, self.a_size[a_ids], begins(a_unit))
        b_ends = token_ends(*b_spans, self.b_size[b_ids], begins(b_unit))
        every, a_at, b_at = align(a_ends, b_ends)
        pairs = (a_ids[a_at] << 32 | b_ids[b_at]).astype("<u8").tobytes()
        cut = (a_ends[a_at] == every) & (b_ends[b_at] == every)
        ends = np.cumsum(sizes)
        links = np.searchsorted(every, ends, side="right")  # up to the end of each unit
        groups = np.cumsum(cut)[links - 1]
        a_text, b_text = ([*map(self.text.__getitem__, x.tolist())] for x in (a_ids, b_ids))
        i, j = ([0, *(x[cut] + 1).tolist()] for x in (a_at, b_at))
        parts = [a_text[p] + "|" + b_text[r] if q - p == 1 == t - r else ",".join(a_text[p:q]) + "|" + ",".join(b_text[r:t]) for p, q, r, t in zip(i, i[1:], j, j[1:])]
        found, n_a, n_b = [], np.bincount(a_unit, minlength=len(units)).tolist(), np.bincount(b_unit, minlength=len(units)).tolist()
        for a, b, g, h, k, m in zip(n_a, n_b, [0, *groups[:-1].tolist()], groups.tolist(), [0, *links[:-1].tolist()], links.tolist()):
            found.append((a, b, h - g, m - k, ";".join(parts[g:h]).encode(), pairs[8 * k : 8 * m]))
        return found

    def __call__(self, units: list[str]) -> list[tuple]:
        """``align_units``, of which two generations are remembered."""
        got = {u: self.known.get(u) or self.older.get(u) for u in units}
        new = [u for u, x in got.items() if not x]
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            got.update(zip(some, self.align_units(some)))
        for u in units:
            if len(u) <= tokens.LONGEST_UNIT and u not in self.known:
                if len(self.known) >= MOST_UNITS:
                    self.known, self.older = {}, self.known
                self.known[u] = got[u]
        return [got[u] for u in units]


_aligners: dict[tuple[str, str], PairAligner] = {}


def aligner(a_path: str, b_path: str) -> PairAligner:
    """This process's aligner for two vocabulary files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = PairAligner(a_path, b_path)
    return _aligners[a_path, b_path]


class Places(dict):
    """Numbers for units in order of first use."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = k = len(self)
        self.new.append(unit)
        return k


class Block:
    """Distinct units of some texts, and each text's unit numbers."""

    def __init__(self, pair: PairAligner, with_groups: bool):
        self.pair, self.with_groups = pair, with_groups
        self.places, self.groups, self.links, self.bad = Places(), [], [], []
        self.counts: list[tuple[int, ...]] = []
        self.used = np.zeros(0, dtype=np.int64)

    def units(self, text: str) -> np.ndarray:
        """Unit numbers of a space and the text. A long text's units are listed some at a time."""
        if len(text) <= AT_ONCE:
            return np.array([*map(self.places.__getitem__, self.pair.unit.findall(" " + text))], dtype=np.int64)
        return np.fromiter((self.places[m.group()] for m in self.pair.unit.finditer(" " + text)), np.int64)

    def add(self, texts: list[str]) -> list[tuple]:
        """For each text: its counts (``COUNTS``), groups_sha256, the groups (if asked for) and its packed unit numbers."""
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        numbers = [self.units(x) if x else np.empty(0, np.int64) for x in texts]
        for record in self.pair(self.places.new):
            self.counts.append(record[:4])
            self.bad.append(record[4] is None)
            self.groups.append(record[4])
            self.links.append(record[5])
        self.places.new = []
        counts, bad = np.array(self.counts, dtype=np.int64).reshape(-1, len(COUNTS)), np.array(self.bad, dtype=bool)
        self.used = np.concatenate([self.used, np.zeros(len(self.bad) - len(self.used), dtype=np.int64)])
        found = []
        for own in numbers:
            if not len(own) or bad[own].any():
                found.append((0, 0, 0, 0, "", "" if self.with_groups else None, pack(b"")))
                continue
            digest, parts = hashlib.sha256(), []
            for k in range(0, len(own), 100_000):
                part = (b";" if k else b"") + b";".join(map(self.groups.__getitem__, own[k : k + 100_000].tolist()))
                digest.update(part)
                if self.with_groups:
                    parts.append(part)
            self.used += np.bincount(own, minlength=len(self.used))
            steps = np.diff(np.sort(own), prepend=0).astype("<u4")
            found.append((*counts[own].sum(axis=0).tolist(), digest.hexdigest(), b"".join(parts).decode() if self.with_groups else None, pack(steps.tobytes())))
        return found

    def close(self) -> dict[str, bytes]:
        """The block's table: distinct pairs and how many links have each; per unit, how many links and their pairs' places."""
        links = np.frombuffer(b"".join(self.links), "<u8")
        sizes = np.fromiter(map(len, self.links), np.int64, len(self.links)) // 8
        pairs, place = np.unique(links, return_inverse=True)
        times = np.bincount(place, weights=np.repeat(self.used, sizes), minlength=len(pairs)).astype("<u8")
        return {"pairs": pairs.astype("<u8").tobytes(), "times": times.tobytes(), "sizes": sizes.astype("<u4").tobytes(), "at": place.astype("<u4").tobytes()}


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """A row per document, and one per block of a task's documents with its table of pairs (``is_block``)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = common.sql_type(rows, "doc_id")
    schema = f"block long, is_block boolean, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, units binary, pairs binary, times binary, sizes binary, at binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task, k, held = aligner(a_path, b_path), TaskContext.get().partitionId(), 0, 0
        block = Block(pair, with_groups)
        for batch in batches:
            for part, texts in common.text_slices(batch, "text"):
                number = {"block": task << 32 | k, "is_block": False}
                yield to_batch([number | dict(zip(own, x)) for x in block.add(texts)], part.column("doc_id"))
                held += sum(map(len, texts)) + ROW_CHARS * len(texts)
                if held >= BLOCK_CHARS:
                    yield to_batch([number | {"is_block": True} | block.close()], pa.nulls(1, part.column("doc_id").type))
                    block, k, held = Block(pair, with_groups), k + 1, 0
        if held:
            yield to_batch([number | {"is_block": True} | block.close()], pa.nulls(1, part.column("doc_id").type))

    names = [x.split()[0] for x in schema.split(", ")]
    own = [*COUNTS, "groups_sha256", "groups", "units"]
    kinds = dict(zip(names, [pa.int64(), pa.bool_(), None, *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.binary()] * 5]))

    def to_batch(some: list[dict], ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids if c == "doc_id" else pa.array([x.get(c) for x in some], kinds[c]) for c in names], names=names)

    return rows.mapInArrow(run, schema)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """block, at (the pair's place in its block), a, b (ids), n (links of the block), from the blocks' tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "times"))):
                pairs, times = np.frombuffer(pairs, "<u8"), np.frombuffer(times, "<u8").astype(np.int64)
                at = np.flatnonzero(times)
                own = pairs[at]
                for k in range(0, len(at), 100_000):
                    s = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[s]), block)), pa.array(at[s].astype(np.int32)), pa.array((own[s] >> 32).astype(np.int32)), pa.array((own[s] & 0xFFFFFFFF).astype(np.int32)), pa.array(times[at[s]])], names=["block", "at", "a", "b", "n"])

    return blocks.filter("is_block").select("block", "pairs", "times").mapInArrow(run, "block long, at int, a int, b int, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n (links that hold the pair linked, in all texts) and is_best (no other a has more links with this b), from
    ``block_pairs``. The rows are at most those pairs of two vocabularies that overlap anywhere."""
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("is_best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every whole text, after a space, encoded by A (a byte-level vocabulary of the ``tokenizers`` library) and B (a
    sentencepiece model, which adds the space), aligned by bytes.

    Returns the documents and the corpus-wide pairs (``pair_counts``). Documents: doc_id, n_a, n_b (tokens), n_groups,
    n_links (pairs of an A and a B token whose bytes overlap), n_best (links whose pair is the most frequent one of its
    B id), count_sum (of its links' corpus-wide counts; all long), groups_sha256, and groups (string) if asked for. A
    row per input row; equal rows each count. A null or empty text, or one that either tokenizer doesn't give back
    byte by byte, has no tokens: zeros and an empty groups_sha256. A null id stays null; other columns are left behind.
    """
    blocks = common.cut(aligned_blocks(docs, a_path, b_path, id_col, text_col, with_groups), "aligned")
    pairs = block_pairs(blocks)
    counts = common.cut(pair_counts(pairs), "pairs")
    rated = pairs.join(counts.withColumnRenamed("n", "total"), ["a", "b"]).select("block", "at", "total", "is_best")
    own = blocks.select("block", "is_block", "doc_id", *COUNTS, "groups_sha256", *["groups"] * with_groups, "units", "sizes", "at")
    out = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        import pyarrow.compute as pc
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        rows = left.filter(pc.invert(left.column("is_block")))
        table = left.filter(left.column("is_block")).to_pylist()[0]
        sizes, at = (np.frombuffer(table[c], "<u4").astype(np.int64) for c in ("sizes", "at"))
        places = right.column("at").to_numpy()
        values = np.zeros((2, int(at.max()) + 1 if len(at) else 0), dtype=np.int64)
        values[0, places] = right.column("is_best").to_numpy().astype(np.int64)
        values[1, places] = right.column("total").to_numpy()
        ends = np.cumsum(sizes)
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(values[:, at], axis=1)], axis=1)
        of_unit = sums[:, ends] - sums[:, ends - sizes]
        found = np.array([of_unit[:, np.cumsum(np.frombuffer(unpack(u), "<u4"), dtype=np.int64)].sum(axis=1) for u in rows.column("units").to_pylist()], dtype=np.int64).reshape(-1, 2)
        columns = {c: rows.column(c) for c in ("doc_id", *COUNTS, "groups_sha256", *["groups"] * with_groups)}
        columns |= {"n_best": pa.array(found[:, 0]), "count_sum": pa.array(found[:, 1])}
        return pa.table([columns[c] for c in out], names=out)

    schema = f"doc_id {common.sql_type(blocks, 'doc_id')}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return own.groupBy("block").cogroup(rated.groupBy("block")).applyInArrow(finish, schema), counts.select("a", "b", "n", "is_best")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two public tokenizers, aligned."""
    docs = common.table(spark, sf_dir, "documents")
    return align_documents(docs, tokens.public_path("byte_bpe_50k.json"), tokens.public_path("piece_bpe_32k.model"))[0]
