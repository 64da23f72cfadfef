import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from cadenza.llm import bpe, packing, token_files, tokens

from .cases import TEXTS, documents

BYTE, WORD = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("word_bpe_49k.json")


def odd_texts(n=4000):
    rng = random.Random(1)
    parts = list("aaaab  '  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　é́ßİΣς日本語🙂!?.,019²½ǅ\x00\x01<|>") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "   ", "é", "​", "ﬁ", "Å"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)] + ["a" * 3000, "ab" * 2000] + [t or "" for _, t in TEXTS]


@pytest.mark.parametrize("path, byte_level", [(BYTE, True), (WORD, False)])
def test_encoder_equals_the_library(spark, monkeypatch, path, byte_level):
    rng = random.Random(2)
    simple = [chr(c) for c in range(0x3000) if not tokens.NOT_SIMPLE.search(chr(c))]
    texts = odd_texts() + ["".join(rng.choice(simple) if rng.random() < 0.4 else rng.choice(" 'sTdllRe1aOn!\n") for _ in range(60)) for _ in range(4000)]
    texts += [*simple, " " * 1_500_000 + "x", "a" * 450_000, "é日" * 100_000, "x" + "\n" * 300_000 + "y", "!" * 300_000, "É1!" * 50_000]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    library = tokens.load(path)
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    encode = tokens.UnitEncoder(path, byte_level)
    assert encode.pattern is not None
    for _ in range(2):  # the second time from what is known
        assert encode(texts) == want
    small = tokens.UnitEncoder(path, byte_level)
    small.units.most = 5_000  # generations change within a text
    assert small(texts[:6000]) == want[:6000]
    assert tokens.UnitEncoder(path, not byte_level).pattern is None


def test_pair_index_bpe_equals_the_library():
    texts, library, own = odd_texts(), tokens.load(BYTE), bpe.PairIndexBpe(BYTE)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want
    assert [own.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    assert own.decode([255, 10]) == library.decode([255, 10], skip_special_tokens=False)  # bytes that aren't UTF-8


def test_bpe_query_rows(spark):
    import hashlib

    library = tokens.load(BYTE)
    rows = bpe.digest_documents(bpe.encode_documents(documents(spark), BYTE), BYTE).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    assert bpe.digest_documents(bpe.encode_documents(documents(spark, []), BYTE), BYTE).collect() == []


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(100):
        ids = rng.integers(0, 2 ** rng.integers(1, 33), rng.integers(1, 3000), dtype=np.uint64).astype("<u4")
        if rng.random() < 0.2:
            ids[:] = 7
        blocks = token_files.encode_blocks(ids)
        starts = np.cumsum([0, *map(len, blocks)])[:-1]
        assert (token_files.decode_blocks(b"".join(blocks), starts) == ids).all()
    skewed = np.where(rng.random(51_200) < 0.05, 2**30, 5).astype("<u4")
    assert sum(map(len, token_files.encode_blocks(skewed))) < 51_200  # outliers don't widen the rest


def test_token_files(spark, tmp_path):
    library = tokens.load(WORD)
    manifest = token_files.write_files(documents(spark), f"file://{tmp_path}/tokens", WORD, 1, byte_level=False)
    rows = token_files.read_files(manifest, with_ids=True).collect()
    hashed = {t: xxhash.xxh64_intdigest(t, 42) for _, t in TEXTS if t is not None} | {None: 42}
    signed = {t: h - (h >> 63 << 64) for t, h in hashed.items()}
    want = sorted(((i, t) for i, t in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0, signed[x[1]]))
    at = 0
    for row, (i, t) in zip(sorted(rows, key=lambda r: r["start"]), want, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (i, at, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    reader = token_files.FileReader(manifest.first()["path"])
    k = len(reader.docs) - 1
    assert len(reader.document(k)) == reader.counts[k] and reader.document(k)[-1] == 1
    empty = token_files.write_files(documents(spark, []), f"file://{tmp_path}/none", WORD, 1, byte_level=False)
    assert token_files.read_files(empty).collect() == []


def test_token_files_of_one_id_in_several_parts_and_files(spark, tmp_path):
    rows = spark.range(3_000).selectExpr("if(id < 2500, 7, id) as doc_id", "if(id % 3 = 0, 'the same words', concat('w', id)) as text").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows lie in one part
    try:
        manifest = token_files.write_files(rows, f"file://{tmp_path}/tokens", WORD, 1, byte_level=False, file_docs=200)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = manifest.collect()
    assert len({r["part"] for r in parts}) > 2 and max(r["file"] for r in parts) > 0 and max(r["documents"] for r in parts) == 200
    got = sorted((r["start"], r["n_tokens"], r["doc_id"], tuple(r["ids"])) for r in token_files.read_files(manifest, with_ids=True).collect())
    assert [x[0] for x in got] == [0, *np.cumsum([x[1] for x in got])[:-1].tolist()]
    assert [x[2] for x in got] == sorted(x[2] for x in got)
    library = tokens.load(WORD)
    assert Counter(x[2:] for x in got) == Counter((r["doc_id"], (*library.encode(r["text"], add_special_tokens=False).ids, 1)) for r in rows.collect())


def test_fill_is_best():
    rng = random.Random(3)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fill(room, counts)
        assert all(n <= counts[x] for x, n in chosen.items())
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_uses_everything_once():
    rng = random.Random(4)
    histogram = {rng.randint(1, 1024): rng.randint(1, 500) for _ in range(200)}
    used = Counter()
    for window, times in packing.plan_windows(histogram):
        assert times > 0 and sum(k * n for k, n in window.items()) <= 1024
        for k, n in window.items():
            used[k] += n * times
    assert used == Counter(histogram)


def packed_rows(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_packing(spark):
    library = tokens.load(BYTE)
    rows = packing.pack_documents(documents(spark), BYTE, 0, capacity=64, with_ids=True)
    got = rows.collect()
    packed_rows(got, 64)
    want = Counter()
    for i, t in TEXTS:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for a, b in packing.piece_bounds(len(ids), 64):
            want[i, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    windows = {r["sequence_id"]: r for r in packing.sequences(rows, pad_id=9, capacity=64).collect()}
    for k, w in windows.items():
        ids = [x for r in sorted((r for r in got if r["sequence_id"] == k), key=lambda r: r["offset"]) for x in np.frombuffer(r["ids"], "<u4").tolist()]
        n = len(ids)
        assert w["n_tokens"] == n and w["ids"] == ids + [9] * (0 if n & (n - 1) == 0 else 64 - n)
    assert packing.pack_documents(documents(spark, []), BYTE, 0).collect() == []


def test_pieces_cover_a_document():
    for n in range(1, 400):
        bounds = packing.piece_bounds(n, 64)
        assert [x for a, b in bounds for x in range(a, b)] == list(range(n)) and all(b - a <= 64 for a, b in bounds)


@pytest.mark.parametrize("hot", [700, 400, 1030, 20])
def test_packing_pads_little_and_splits_hot_lengths(spark, hot):
    sizes = [hot if i % 3 == 0 else 1 + i * 7919 % 3000 for i in range(20_000)]
    pieces = [(i, b - a) for i, n in enumerate(sizes) for a, b in packing.piece_bounds(n, 1024)]
    rows = packing.pack(spark.createDataFrame(pieces, "doc_id long, length long"), 1024).collect()
    by = packed_rows(rows, 1024)
    assert len(rows) == len(pieces) and sum(n for _, n in pieces) / (1024 * len(by)) > 0.97


def test_a_bad_length_is_an_error(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.sql("select 1L as doc_id, 2000L as length"), 1024)
