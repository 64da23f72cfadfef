"""Web archives (WARC 1.1) and their index, merged externally.

Pages become records of gzip-compressed archive files; a payload that an earlier page had becomes a revisit
record. The archives are read back record by record, and every reading task leaves its captures as runs:
files of lines sorted by URL key, time and page. The runs are merged: keys sampled from them cut the key space
into ranges (a URL with very many captures is cut by time and page), and a task per range reads its slice of
each run as a stream through a loser tree. If there are more runs than a tree may have leaves, groups of runs
are merged first. What comes out, range after range, is the history of captures in global order.

Files are written through Arrow's file systems into a folder that driver and executors share, under a name
of their own and then moved, so a repeated or doubled task leaves one whole file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads that are shorter are always written whole.
LEAST_REVISIT = 100
#: An archive file is closed beyond so many bytes, a run after so many captures.
ARCHIVE_BYTES, RUN_CAPTURES = 64_000_000, 100_000
#: Runs merged at once; lines between entries of a run's sparse index; sampled keys at least.
FAN_IN, STRIDE, SAMPLE = 64, 128, 20_000
#: Captures that a task takes from one run at least, about, before a level has more ranges (1.5 MB or so), and those of
#: a range of the result; tables of few captures have a range per core all the same.
SLICE_CAPTURES, RANGE_CAPTURES, FEW_CAPTURES = 8_192, 500_000, 1_000
READ_BYTES = 1 << 18
BASE_DATE, DATE_SPAN = datetime(2024, 1, 1, tzinfo=timezone.utc), 315_360_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "urlkey string, timestamp string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, filename string, offset long, length long"


class SharedFile:
    """A file that gets its name when it is whole."""

    def __init__(self, path: str):
        self.path, self.own = path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.fs, at = common.filesystem(self.own)
        self.out, self.size = self.fs.open_output_stream(at, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(common.filesystem(self.own)[1], common.filesystem(self.path)[1])


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def capture_time(page_id: int | None) -> datetime:
    """Pages have no time of their own: seconds after a fixed date, by page."""
    return BASE_DATE + timedelta(seconds=(page_id or 0) % DATE_SPAN)


def url_key(url: str) -> str:
    """The sort key of a URL: lower-case host labels from the right, then port, path and query, without white space."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return quote(url, safe="%/:?=&+,;@!$'()*~#[]")
    if not host:
        return quote(url, safe="%/:?=&+,;@!$'()*~#[]")
    labels = host.removeprefix("www.").split(".")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + rest, safe="%/:?=&+,;@!$'()*~")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, is_revisit: bool) -> bytes:
    """One record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = {
        "WARC-Type": "revisit" if is_revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Target-URI": quote(url, safe="%/:?=&+,;@!$'()*~#[]") if url else "urn:unknown",
        "WARC-Date": capture_time(page_id).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if is_revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first, digest), "X-Refers-To-Page": str(first)}
    if page_id is not None:
        head["X-Page"] = str(page_id)
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream, one at a time."""
    at, rest = 0, b""
    while True:
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not rest:
                rest = bytes(stream.read(READ_BYTES))
                if not rest:
                    if used:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(inflate.decompress(rest))
            used += len(rest) - len(inflate.unused_data)
            rest = inflate.unused_data
        yield at, used, b"".join(parts)
        at += used


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of a record; header names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def plan_records(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, first, is_revisit: which pages repeat another's payload of at least
    ``least_revisit`` bytes, and the least page with it. Rows of equal id and payload are alike in this: all are
    responses, or all revisits. A null id is never the least unless no other has the payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.filter(F.octet_length("html") >= least_revisit)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    # small payloads meet none; a key of their own deals them out evenly
    key = F.when(F.octet_length("html") >= least_revisit, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    found = rows.withColumn("key", key).join(first.withColumnRenamed("digest", "key"), "key", "left").drop("key")
    return found.withColumn("is_revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``plan_records``' rows to archive files in ``folder``; returns the stored manifest (path, records, bytes)."""
    fs, at = common.filesystem(folder)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, n, made = TaskContext.get().partitionId(), None, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, first, revisit = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "digest", "first", "is_revisit"))
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = deflate.compress(record_bytes(page, url, html.encode("utf-8", "surrogatepass"), digest, first, revisit)) + deflate.flush()
                out = out or SharedFile(f"{folder}/part-{part:06d}-{len(made):06d}.warc.gz")
                out.write(data)
                n += 1
                if out.size >= archive_bytes:
                    out.close()
                    made.append((out.path, n, out.size))
                    out, n = None, 0
        if out:
            out.close()
            made.append((out.path, n, out.size))
        yield table(made, ["path", "records", "bytes"], [pa.string(), pa.int64(), pa.int64()])

    return common.cut(records.mapInArrow(write, "path string, records long, bytes long"), "archives")


def table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)


def read_records(manifest: DataFrame) -> DataFrame:
    """The archives' records: uri, record_type, page_id, digest, payload (binary; null for revisits), filename, offset."""
    spread = manifest.select("path").repartition(parallelism(manifest.sparkSession))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = common.filesystem(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    for offset, _, data in members(stream):
                        warc, _, payload = parse_record(data)
                        row = (warc["warc-target-uri"], warc["warc-type"], int(warc["x-page"]) if "x-page" in warc else None, warc["warc-payload-digest"].removeprefix("sha256:"), payload if warc["warc-type"] == "response" else None, path, offset)
                        yield table([row], ["uri", "record_type", "page_id", "digest", "payload", "filename", "offset"], [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()])

    return spread.mapInArrow(read, "uri string, record_type string, page_id long, digest string, payload binary, filename string, offset long")


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def capture_line(path: str, offset: int, length: int, data: bytes) -> bytes:
    """A record's line in the index. Lines sort as bytes: URL key, time, page (none first), then the rest."""
    warc, http, payload = parse_record(data)
    digest = warc["warc-payload-digest"].removeprefix("sha256:")
    if warc["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{path}, {offset}: the payload is not the one that was written")
    page = int(warc["x-page"]) if "x-page" in warc else None
    refers = int(warc["x-refers-to-page"]) if "x-refers-to-page" in warc else None
    size = len(payload) if warc["warc-type"] == "response" else int(http["content-length"])
    time = "".join(c for c in warc["warc-date"] if c.isdigit())
    rest = json.dumps([page, warc["warc-type"], digest, size, refers, path, offset, length])
    return f"{url_key(warc['warc-target-uri'])}\t{time}\t{'-' if page is None else f'{page + (1 << 63):020d}'}\t{rest}\n".encode()


def parse_line(line: bytes) -> tuple:
    key, time, _, rest = line.decode().rstrip("\n").split("\t", 3)
    page, kind, digest, size, refers, path, offset, length = json.loads(rest)
    return key, time, page, kind, digest, size, refers, path, offset, length


RUN = "path string, captures long, keys array<binary>, offsets array<long>, bytes long"
RUN_KINDS = [pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64()]


def write_run(lines: Iterable[bytes], path: str) -> tuple[str, int, list[bytes], list[int], int]:
    """Write sorted lines; (path, lines, every STRIDEth line, its offset, bytes)."""
    out, keys, offsets, n = SharedFile(path), [], [], 0
    lines = iter(lines)
    while some := list(islice(lines, STRIDE)):
        keys.append(some[0])
        offsets.append(out.size)
        out.write(b"".join(some))
        n += len(some)
    out.close()
    return path, n, keys, offsets, out.size


def index_runs(manifest: DataFrame, folder: str, run_captures: int = RUN_CAPTURES) -> DataFrame:
    """Read the archives and leave each task's captures as sorted runs; the stored table of runs: path, captures,
    keys and offsets (the sparse index), bytes."""
    fs, at = common.filesystem(folder)
    fs.create_dir(at, recursive=True)
    spread = manifest.select("path").repartition(parallelism(manifest.sparkSession))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lines, made = TaskContext.get().partitionId(), [], []

        def leave() -> None:
            lines.sort()
            made.append(write_run(lines, f"{folder}/run-{part:06d}-{len(made):06d}"))
            lines.clear()

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = common.filesystem(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    for offset, length, data in members(stream):
                        lines.append(capture_line(path, offset, length, data))
                        if len(lines) >= run_captures:
                            leave()
        if lines:
            leave()
        yield table(made, ["path", "captures", "keys", "offsets", "bytes"], RUN_KINDS)

    return common.cut(spread.mapInArrow(index, RUN), "runs")


def run_lines(path: str, start: int, end: int, low: bytes, high: bytes | None) -> Iterator[bytes]:
    """Lines of a run in [low, high), read from ``start`` to ``end`` a buffer at a time."""
    fs, at = common.filesystem(path)
    with fs.open_input_file(at) as file:
        file.seek(start)
        rest, left = b"", end - start
        while left or rest:
            data = file.read(min(READ_BYTES, left))
            left -= len(data)
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            if not data and rest:
                raise ValueError(f"{path} ends inside a line")
            for line in lines:
                line += b"\n"
                if high is not None and line >= high:
                    return
                if line >= low:
                    yield line


class LoserTree:
    """Merges sorted iterators. Each inner node keeps the loser of the match played there, so the next line costs
    one match per level on the winner's way up."""

    def __init__(self, runs: list[Iterator[bytes]]):
        self.runs, k = runs, max(1, len(runs))
        self.size = 1 << (k - 1).bit_length()
        self.heads: list[bytes | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        """Whether leaf a's line goes before leaf b's; a leaf that has ended goes last, ties by leaf."""
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b) if x is not None or y is not None else a < b

    def __iter__(self) -> Iterator[bytes]:
        while (line := self.heads[self.winner]) is not None:
            yield line
            leaf = self.winner
            self.heads[leaf] = next(self.runs[leaf], None)
            node = leaf + self.size >> 1
            while node:
                if self._first(self.losers[node], leaf):
                    self.losers[node], leaf = leaf, self.losers[node]
                node >>= 1
            self.winner = leaf


def sampled_keys(runs: DataFrame, most: int) -> list[bytes]:
    """Up to ``most`` of the runs' index keys, by hash, in order."""
    keys = runs.select(F.explode("keys").alias("key"))
    return sorted(bytes(r["key"]) for r in keys.orderBy(F.xxhash64("key"), "key").limit(most).collect())


def slices_of(runs: DataFrame, bounds: list[bytes], groups: int) -> DataFrame:
    """A row per range and group of runs with the slices of its runs: range, grp, slices."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for k in range(bisect_right(bounds, r["keys"][0]), len(bounds) + 1):
                    low, high = bounds[k - 1] if k else b"", bounds[k] if k < len(bounds) else None
                    a = max(0, bisect_right(r["keys"], low) - 1)
                    b = len(r["keys"]) if high is None else bisect_left(r["keys"], high)
                    if b > a:
                        rows.append((k, r["path"], r["offsets"][a], r["offsets"][b] if b < len(r["keys"]) else r["bytes"]))
            yield table(rows, ["range", "path", "start", "end"], [pa.int64(), pa.string(), pa.int64(), pa.int64()])

    slices = runs.select("path", "keys", "offsets", "bytes").mapInArrow(cut_up, "range long, path string, start long, end long")
    group = F.pmod(F.xxhash64("path"), F.lit(groups)) if groups > 1 else F.lit(0)
    rows = slices.groupBy("range", group.cast("long").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("path", "start", "end"))).alias("slices"))
    return rows.repartitionByRange((len(bounds) + 1) * groups, "range", "grp").sortWithinPartitions("range", "grp")


def merge_runs(runs: DataFrame, folder: str, fan_in: int = FAN_IN, slice_captures: int = SLICE_CAPTURES) -> DataFrame:
    """All captures of the runs (``index_runs``), in the order of their lines: partition after partition, and within
    each. Columns: see CAPTURE.

    If a key may meet more than ``fan_in`` runs, groups of half as many are merged into longer runs first. A level has
    as many ranges as leave a task about ``slice_captures`` captures of each run, so slices stay large at any size.
    """
    fs, at = common.filesystem(folder)
    fs.create_dir(at, recursive=True)
    total, meet = runs.agg(F.coalesce(F.sum("captures"), F.lit(0)), F.count("*")).first()
    last = max(2, -(-total // RANGE_CAPTURES), min(parallelism(runs.sparkSession), total // FEW_CAPTURES))
    sample = sampled_keys(runs, max(SAMPLE, 10 * last))  # some keys for each range of the result

    def bounds_for(want: int) -> list[bytes]:
        want = min(want, len(sample))
        return sorted({sample[i * len(sample) // want] for i in range(1, want)})

    def merged(row: dict, bounds: list[bytes]) -> Iterator[bytes]:
        k = row["range"]
        low, high = bounds[k - 1] if k else b"", bounds[k] if k < len(bounds) else None
        return iter(LoserTree([run_lines(s["path"], s["start"], s["end"], low, high) for s in row["slices"]]))

    def to_runs(level: int, bounds: list[bytes]) -> Callable:
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    made = write_run(merged(row, bounds), f"{folder}/level-{level}-{row['range']:06d}-{row['grp']:06d}")
                    yield table([made] if made[1] else [], ["path", "captures", "keys", "offsets", "bytes"], RUN_KINDS)

        return write

    level = 0
    while meet > fan_in:
        meet = -(-2 * meet // fan_in)  # groups of half the fan-in on average, as hashing deals unevenly
        bounds = bounds_for(max(1, total // (meet * (fan_in // 2) * slice_captures)))
        runs = common.cut(slices_of(runs, bounds, meet).mapInArrow(to_runs(level, bounds), RUN), "runs")
        level += 1

    bounds = bounds_for(last)
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in CAPTURE.split(", ")]

    def to_captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                some = []
                for line in merged(row, bounds):
                    some.append(parse_line(line))
                    if len(some) >= 10_000:
                        yield table(some, names, kinds)
                        some = []
                yield table(some, names, kinds)

    return slices_of(runs, bounds, 1).mapInArrow(to_captures, CAPTURE)


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) to archives in ``folder`` and read them back: their captures in the order of
    URL key, time and page (see CAPTURE), one per input row.

    Null html is an empty payload, a null url has a key of its own, a null page_id stays null. Other columns are
    left behind. No rows: no archives and no captures.
    """
    archives = write_archives(plan_records(pages), f"{folder}/archives")
    return merge_runs(index_runs(archives, f"{folder}/runs"), f"{folder}/merged")


def warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture as the merged index has it: the history of each URL key in order of time."""
    return archive_pages(common.table(spark, sf_dir, "pages"), common.work_dir(spark, "warc")).drop("filename")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, from the merged index of the archives that it was written to."""
    captures = archive_pages(common.table(spark, sf_dir, "pages"), common.work_dir(spark, "warc"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
  f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select p.page_id, p.n as payload_bytes, p.d as payload_digest,
  case when f.first_id <> p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first_id <> p.page_id then f.first_id end as refers_to
from p left join f on f.d = p.d and p.n >= 100"""
