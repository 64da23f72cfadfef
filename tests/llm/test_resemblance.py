import numpy as np
import pytest

from cadenza.llm import resemblance, simhash

from .cases import documents


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_kept(texts):
    """Numbers of the texts that are the first of their component."""
    sets, root = sets_of(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def edited(rng, n=60):
    """Texts of 150 words and copies with a few words changed, some below 0.8, and copies of copies."""
    texts = []
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 5_000, 150)]
        texts.append(" ".join(words))
        for _ in range(4):
            words = list(words)
            for k in rng.integers(0, 150, rng.integers(1, 6)):
                words[k] = "changed"
            texts.append(" ".join(words))
    return texts


def test_pipeline_links_edited_copies(spark, tmp_path):
    import corpus_pipeline

    texts = [t for _, t in zip(range(300), edited(np.random.default_rng(5)))]
    docs = documents(spark, list(enumerate(texts)))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(brute_kept(texts))


@pytest.mark.parametrize("most_held", [2_000, 3])
def test_texts_apart_from_the_least_of_their_bucket_still_meet(spark, monkeypatch, most_held):
    # every text in one bucket, whose least is unlike all: the others are linked all the same
    monkeypatch.setattr(resemblance, "MOST_OTHERS", 2)
    texts = edited(np.random.default_rng(6), 4)
    keys = [resemblance.key_of(resemblance.words_of(t)) for t in texts]
    keys = [k - (1 << 64) if k >> 63 else k for k in keys]
    members = resemblance.crowded(spark.createDataFrame([(7, k) for k in keys], "bucket long, key long"))
    edges = resemblance.links(members, spark.createDataFrame([*zip(keys, texts)], "key long, text string"), most_held=most_held).collect()
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for r in edges:
        root[find(r["a"])] = find(r["b"])
    assert len({find(k) for k in keys}) == len(brute_kept(texts))


def test_many_unlike_texts_of_one_bucket_are_no_copies(spark, monkeypatch):
    # a passage that all share brings them into one bucket; all but a few are unlike each other
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 40)) for _ in range(5_000)]
    near = {k: k + 2500 for k in range(10, 100, 10)}
    for k, other in near.items():
        texts[other] = texts[k] + " another end"
    rows = []
    whole = resemblance.confirmed_within
    monkeypatch.setattr(resemblance, "confirmed_within", lambda apart, *more: rows.append(apart.count()) or whole(apart, *more))
    members = resemblance.crowded(spark.createDataFrame([(7, k) for k in range(len(texts))], "bucket long, key long"))
    table = spark.createDataFrame([*enumerate(texts)], "key long, text string")
    edges = resemblance.links(members, table, most_held=500).collect()
    assert {tuple(sorted((r.a, r.b))) for r in edges} == set(near.items())
    assert sum(rows) < 100  # beside them only each text with the bucket's least


def test_odd_rows(spark):
    docs = documents(spark)
    kept = [(r["doc_id"], r["text"]) for r in simhash.deduplicate(docs).select("doc_id", "text").collect()]
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert len(set(kept)) == len(kept) and set(kept) <= set(given)
    assert len(kept) == len(brute_kept([t for _, t in given]))
    assert simhash.deduplicate(documents(spark, [])).collect() == []


def test_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [rows[i][0] for i in sorted(brute_kept([t for _, t in rows]))]


def test_repeated_rows_of_one_id(spark):
    many = spark.range(2_000).selectExpr("7L as doc_id", "'the same words again and again in every row' as text", "id % 3 as other")
    for most in (0, simhash.MOST_BROADCAST):
        kept = simhash.deduplicate(many.union(spark.sql("select 8L, 'something else', 0L union all select 9L, 'something else', 0L")), most_broadcast=most).collect()
        assert sorted(r["doc_id"] for r in kept) == [7, 8]
