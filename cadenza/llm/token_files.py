"""Token ids in binary files of patched frame-of-reference blocks.

A file, all numbers little-endian:

    "PFRTOK01"
    blocks of BLOCK ids (the last may be shorter), each
        minimum u32 | ids u16 | width u8 | unused u8 | exceptions u16 | unused u16
        packed: (id - minimum) mod 2**width, width bits each, lowest bit first
        exceptions: position u16 each, then id - minimum u32 each
    documents: id i64 each, ids in it u32 each, whether its id is known u8 each
    block starts: u64 each
    documents u64 | blocks u64 | where the documents' table starts u64 | "PFRTOK01"

The width is the one that holds a share (``PERCENTILE``) of a block's differences; wider ones are stored
whole in the exception list. The block starts let a reader fetch any range of ids without the rest.

Files are written by tasks through Arrow's file systems into a folder that driver and executors share,
under a name of their own and then moved, so a repeated or doubled task leaves one whole file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"PFRTOK01"
BLOCK = 512
PERCENTILE = 0.9
#: A file is closed after so many ids or documents.
FILE_IDS, FILE_DOCS = 8_000_000, 500_000
#: Ids that are encoded or decoded at once.
AT_ONCE = 512 * BLOCK
HEAD = np.dtype([("minimum", "<u4"), ("ids", "<u2"), ("width", "u1"), ("_a", "u1"), ("exceptions", "<u2"), ("_b", "<u2")])
TAIL = np.dtype([("documents", "<u8"), ("blocks", "<u8"), ("table", "<u8"), ("magic", "S8")])


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids (u32); all but the last are full."""
    n = len(ids)
    if not n:
        return []
    rows = -(-n // BLOCK)
    last = n - (rows - 1) * BLOCK
    table = np.empty(rows * BLOCK, dtype="<u4")
    table[:n] = ids
    table[n:] = ids[(rows - 1) * BLOCK :].min()
    table = table.reshape(rows, BLOCK)
    minimum = table.min(axis=1)
    delta = table - minimum[:, None]
    at = min(BLOCK - 1, int(np.ceil(PERCENTILE * BLOCK)) - 1)
    typical = np.partition(delta, at, axis=1)[:, at].astype(np.float64)
    width = np.where(typical > 0, np.floor(np.log2(np.maximum(typical, 1))) + 1, 0).astype(np.int64)
    over = delta >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0
    over[width >= 32] = False
    heads = np.zeros(rows, dtype=HEAD)
    heads["minimum"], heads["ids"], heads["width"], heads["exceptions"] = minimum, BLOCK, width, over.sum(axis=1)
    heads["ids"][-1] = last
    out: list[bytes] = [b""] * rows
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(delta[own].reshape(-1, 1).view(np.uint8), axis=1, bitorder="little", count=int(w))
            packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        for k, i in enumerate(own.tolist()):
            where = np.flatnonzero(over[i])
            out[i] = b"".join((heads[i].tobytes(), packed[k].tobytes() if w else b"", where.astype("<u2").tobytes(), delta[i, where].astype("<u4").tobytes()))
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts`` in ``data``."""
    heads = np.array([np.frombuffer(data, HEAD, 1, int(s))[0] for s in starts], dtype=HEAD)
    table = np.zeros((len(starts), BLOCK), dtype="<u4")
    for w in np.unique(heads["width"]).tolist():
        own = np.flatnonzero(heads["width"] == w)
        if w:
            size = BLOCK * w // 8
            packed = np.stack([np.frombuffer(data, np.uint8, size, int(starts[i]) + HEAD.itemsize) for i in own])
            bits = np.zeros((len(own) * BLOCK, 32), dtype=np.uint8)
            bits[:, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(-1, w)
            table[own] = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(len(own), BLOCK)
    for i in np.flatnonzero(heads["exceptions"]):
        n, at = int(heads["exceptions"][i]), int(starts[i]) + HEAD.itemsize + BLOCK * int(heads["width"][i]) // 8
        table[i, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    table += heads["minimum"][:, None]
    keep = np.arange(BLOCK)[None, :] < heads["ids"][:, None]
    return table[keep]


class FileWriter:
    """One file; ``close`` moves it to its name."""

    def __init__(self, path: str):
        self.path, self.own = path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.fs, at = common.filesystem(self.own)
        self.out = self.fs.open_output_stream(at)
        self.out.write(MAGIC)
        self.at, self.ids, self.held = len(MAGIC), 0, 0
        self.pending: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.ids += len(ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= AT_ONCE:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, "<u4")
        n = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for a in range(0, n, AT_ONCE):
            for block in encode_blocks(ids[a : min(n, a + AT_ONCE)]):
                self.starts.append(self.at)
                self.out.write(block)
                self.at += len(block)
        self.pending, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(True)
        known = np.array([x is not None for x in self.docs], dtype=np.uint8)
        tail = np.zeros(1, dtype=TAIL)
        tail["documents"], tail["blocks"], tail["table"], tail["magic"] = len(self.docs), len(self.starts), self.at, MAGIC
        for part in (np.array([x or 0 for x in self.docs], "<i8"), np.array(self.counts, "<u4"), known, np.array(self.starts, "<u8"), tail):
            self.out.write(part.tobytes())
        self.out.close()
        self.fs.move(common.filesystem(self.own)[1], common.filesystem(self.path)[1])


class FileReader:
    """A file's documents; blocks are fetched as they are needed."""

    def __init__(self, path: str):
        fs, at = common.filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = np.frombuffer(self.file.read_at(TAIL.itemsize, size - TAIL.itemsize), TAIL)[0]
        if tail["magic"] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        docs, blocks, self.table = int(tail["documents"]), int(tail["blocks"]), int(tail["table"])
        data = self.file.read_at(size - TAIL.itemsize - self.table, self.table)
        self.docs = np.frombuffer(data, "<i8", docs)
        self.counts = np.frombuffer(data, "<u4", docs, 8 * docs)
        self.known = np.frombuffer(data, np.uint8, docs, 12 * docs) > 0
        self.starts = np.frombuffer(data, "<u8", blocks, 13 * docs)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])

    def ids(self, first: int, n: int) -> np.ndarray:
        """The ids from position ``first`` of the file on."""
        if not n:
            return np.empty(0, "<u4")
        a, b = first // BLOCK, -(-(first + n) // BLOCK)
        start = int(self.starts[a])
        end = int(self.starts[b]) if b < len(self.starts) else self.table
        found = decode_blocks(self.file.read_at(end - start, start), self.starts[a:b].astype(np.int64) - start)
        return found[first - a * BLOCK :][:n]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.firsts[k]), int(self.counts[k]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids), in the file's order, decoding many blocks at once."""
        k, n = 0, len(self.docs)
        while k < n:
            stop = max(k + 1, int(np.searchsorted(self.firsts, self.firsts[k] + AT_ONCE, side="right")) - 1)
            base = int(self.firsts[k])
            ids = self.ids(base, int(self.firsts[stop]) - base)
            for i in range(k, stop):
                a = int(self.firsts[i])
                yield (int(self.docs[i]) if self.known[i] else None), a, ids[a - base : a - base + int(self.counts[i])]
            k = stop


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, byte_level: bool, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Encode documents and write their ids to files in ``folder``, in ascending order of id.

    Null text is empty; ``end_id`` follows every document's ids. A null id comes first and stays null; rows of
    equal id are in the order of their texts' XXH64, equal rows as they come, and may lie in several parts. Other
    columns are left behind. Returns the stored manifest: part, file (long; the files' order), path, documents, ids.
    No rows: no files, an empty manifest.
    """
    fs, at = common.filesystem(folder)
    fs.create_dir(at, recursive=True)
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # many rows of one id are cut too, by text and then by where they lie in the input
    order = ["doc_id", "__hash", "__place"]
    rows = rows.withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__hash", "__place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, writer, made = tokens.encoder(tokenizer, byte_level), TaskContext.get().partitionId(), None, []

        def close() -> None:
            writer.close()
            made.append((part, len(made), writer.path, len(writer.docs), writer.ids))

        for batch in batches:
            for rows, texts in common.text_slices(batch, "text"):
                for doc, data in zip(rows.column("doc_id").to_pylist(), encode(texts)):
                    writer = writer or FileWriter(f"{folder}/part-{part:06d}-{len(made):06d}.pfor")
                    writer.add(doc, np.frombuffer(data + end, "<u4"))
                    if writer.ids >= file_ids or len(writer.docs) >= file_docs:
                        close()
                        writer = None
        if writer:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made) if made else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["part", "file", "path", "documents", "ids"])

    return common.cut(rows.mapInArrow(write, "part long, file long, path string, documents long, ids long"), "manifest")


def read_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (long; of the ids
    as little-endian unsigned 32-bit) and, if asked for, ``ids`` (array of int). Files are read in parallel."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))  # a row per writing task
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = Window.partitionBy("part").orderBy("file")
    files = manifest.join(parts, "part").select("path", (F.col("before") + F.sum("ids").over(own) - F.col("ids")).alias("first"))
    files = files.repartition(max(manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(batch.column(c).to_pylist() for c in ("path", "first"))):
                some: list[tuple] = []
                held = 0
                for doc, start, ids in FileReader(path).documents():
                    some.append((doc, first + start, len(ids), zlib.crc32(ids.tobytes()), *([ids] if with_ids else [])))
                    held += 1 + with_ids * len(ids)
                    if held >= 100_000:
                        yield batch_of(some)
                        some, held = [], 0
                yield batch_of(some)

    def batch_of(some: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some) if some else [[]] * len(kinds), kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids (id 1 ends it), written to files in order of doc_id and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_files(docs, common.work_dir(spark, "tokens"), tokens.public_path("word_bpe_49k.json"), end_id=1, byte_level=False)
    return read_files(manifest)
