import math
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import simhash, spotsigs
from cadenza.llm.components import connected_components

from .cases import TEXTS, documents

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, linked):
    """The least index of each one's component, by comparing all."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for text in [t for _, t in TEXTS] + ["A b", "É É É é", "x " * 200_000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_every_near_pair_meets_at_a_home():
    code, rng = simhash.anchors_for(2), np.random.default_rng(0)
    assert (code.count[0] == 1).all()  # perfect: one anchor within the covering radius
    a = rng.integers(-(2**63), 2**63, 500)
    masks = np.append(simhash.flips(2), np.uint64(0))
    b = (a.view(np.uint64) ^ rng.choice(masks, 500)).view(np.int64)
    row, anchor = code.near(b)
    for i, home in enumerate(code.home(a)):
        assert home in anchor[row == i]


def brute_roots(values):
    own = np.unique(values)
    near = classes(own.tolist(), lambda x, y: (x ^ y).bit_count() <= 2)
    return {v: own[r] for v, r in zip(own.tolist(), near)}


def roots_of_edges(values, edges):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def dense(n, seed):
    """Distinct fingerprints around one centre."""
    rng = np.random.default_rng(seed)
    bits = rng.random((n * 2, 64)) < 0.03
    return np.unique(np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel())[:n]


def test_compare_at_crowded_and_split_anchors():
    values = dense(900, 1)
    for size in (37, 2000):  # batches that end inside an anchor, and one that holds it
        for home in (np.arange(len(values)) % 2 == 0, np.ones(len(values), bool)):
            rows = np.concatenate([values[home], values[~home]])
            key = np.concatenate([np.zeros(home.sum(), np.int64), np.ones((~home).sum(), np.int64)])
            batches = ((key[i : i + size], rows[i : i + size]) for i in range(0, len(rows), size))
            edges = [e for a, b in simhash.compare_sorted(batches, 2) for e in zip(a.tolist(), b.tolist())]
            homes = set(values[home].tolist())
            want = [(x, y) for x in homes for y in values.tolist() if 0 < (x ^ y).bit_count() <= 2]
            assert roots_of_edges(values.tolist(), edges) == roots_of_edges(values.tolist(), want)


def test_links_keep_components(spark):
    values = np.concatenate([dense(500, 2), np.random.default_rng(3).integers(0, 2**64, 300, dtype=np.uint64)])
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    want = brute_roots(values)
    for most in (simhash.MOST_HOMES, 3):  # the second splits anchors by salt
        edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, most_homes=most).collect()]
        assert all((a ^ b).bit_count() >= 1 for a, b in edges)
        assert roots_of_edges(list(want), edges) == want


def test_near_duplicates_on_odd_rows(spark):
    got = sorted(map(tuple, simhash.near_duplicates(documents(spark)).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in TEXTS]
    near = classes(fps, lambda x, y: (x ^ y).bit_count() <= 2)
    least = {}
    for (i, _), c in zip(TEXTS, near):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, f"{f:016x}", least.get(c), fps.count(f)) for (i, _), f, c in zip(TEXTS, fps, near)), key=str)
    assert got == want
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_near_duplicates_of_a_whole_table(spark):
    docs = spark.read.parquet(DATA)
    rows = docs.select("doc_id", "text").collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    ids = sorted(fps)
    near = classes([fps[i] for i in ids], lambda x, y: (x ^ y).bit_count() <= 2)
    want = {i: (f"{fps[i]:016x}", ids[c]) for i, c in zip(ids, near)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == want


def test_deduplicate_odd_rows(spark):
    docs = documents(spark)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 4, 5, 7, 8, None, 9, 10], key=str)
    assert simhash.deduplicate(documents(spark, [])).collect() == []


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7), (3, 2), (2, 3)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1300, (150, 2))]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    assert got == roots_of_edges(nodes, edges if (7, 7) not in edges else [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_signatures(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    anchors = set(spotsigs.ANCHORS)
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            after = [x for x in words[i + 1 :] if x not in anchors][:2]
            if len(after) == 2:
                out.add((w, *after))
    return out or ({tuple(words)} if words else set())


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_spotsigs_with_edited_texts(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(spotsigs, "BLOCK_ROWS", 30)  # many blocks
    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.createDataFrame([(i, t) for i, t in TEXTS if i != 4 and i != 6], "doc_id long, text string"), spark.createDataFrame([(2**40, "only one the text of it")], "doc_id long, text string")):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (-r[0] if r[0] is not None else math.inf, r[1]))
        got = sorted(spotsigs.compare_with_edit(docs).collect(), key=lambda r: (-r["doc_id"] if r["doc_id"] is not None else math.inf, r["n_chars"]))
        assert len(got) == len(rows)
        for k, ((i, text), r) in enumerate(zip(rows, got)):
            following, half = rows[(k + 1) % len(rows)][1], len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
            own = plain_signatures(text)
            assert len(r["fingerprint"]) == 8 * len(own)
            assert abs(r["near_edited"] - jaccard(own, plain_signatures(edited))) < 1e-9
            assert abs(r["near_next"] - jaccard(own, plain_signatures(following))) < 1e-9
    assert spotsigs.compare_with_edit(documents(spark, [])).collect() == []


def test_number_above(spark):
    for n in (0, 1, 2, 3, 10, 50):
        cuts = [10 * k for k in range(n, 0, -1)]
        keys = spark.range(-5, 10 * n + 15).withColumnRenamed("id", "k")
        for r in keys.select("k", spotsigs.number_above(F.col("k"), cuts).alias("n")).collect():
            assert r["n"] == sum(c > r["k"] for c in cuts)


def test_spotsigs_search(spark):
    rng = np.random.default_rng(1)
    base = [[f"the w{rng.integers(0, 400)} v{rng.integers(0, 400)}" for _ in range(rng.integers(8, 60))] for _ in range(40)]
    rows = []
    for k, words in enumerate(base):
        for c in range(4):
            edit = list(words)
            for _ in range(rng.integers(0, 1 + len(words) // 5)):
                edit[rng.integers(0, len(edit))] = f"of x{rng.integers(0, 10**6)} y"
            rows.append((k * 10 + c, " ".join(edit)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1])]
    sets = [plain_signatures(t) for _, t in rows]
    keys = [frozenset(s) for s in sets]
    near = classes(sets, lambda a, b: jaccard(a, b) >= 0.8)
    least = {}
    for (i, _), c in zip(rows, near):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, least[c], len({o for o in keys if o != s and jaccard(o, s) >= 0.8})) for (i, _), c, s in zip(rows, near, keys)), key=str)
    got = sorted(map(tuple, spotsigs.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == want and any(n for _, _, n in want)
