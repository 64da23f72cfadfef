import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
import zstandard

from cadenza.llm import labelled, quality_classifier, quality_rules, toxicity

from .cases import TEXTS, documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def base_figures(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    grams = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    inside = [False] * n
    for i in range(n - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            inside[i : i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated = sum(inside)
    return n, sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, n < 20 or 100 * repeated > 30 * n


def excesses(text, limits):
    """The largest share over its limit of repeated n-grams and lines, and of symbols; characters are code points."""
    text = text or ""
    words = WORD.findall(text)
    chars = max(1, sum(map(len, words)))
    worst = 0.0
    for n, limit in limits.duplicate_ngrams.items():
        seen, inside = set(), [False] * len(words)
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in seen:
                inside[i : i + n] = [True] * n
            seen.add(gram)
        worst = max(worst, sum(len(w) for w, x in zip(words, inside) if x) / chars / limit)
    for n, limit in limits.top_ngrams.items():
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        if len(words) >= limits.line_min_words:
            worst = max([worst, *(k * sum(map(len, g)) / chars / limit for g, k in grams.items() if k > 1)])
    seen, repeated = set(), 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own and line in seen:
            repeated += sum(map(len, own))
        seen.add(line)
    symbols = sum(text.count(s) for s in "#*$%&|<>") / max(1, len(words)) / limits.symbols_per_word
    return max(worst, repeated / chars / limits.duplicate_lines), symbols


def test_rules_against_counting(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "b", " ", "\n", "\t", "é#", "\x1c", "\xa0", "\x85", "|", "Ж"], k=rng.randint(0, 300))) for _ in range(400)] + [t or "" for _, t in TEXTS]
    texts += [" ".join(rng.choices([chr(0x430 + i) * rng.randint(1, 9) for i in range(rng.randint(5, 60))], k=rng.randint(15, 90))) for _ in range(400)]
    texts += [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    kept = 0
    for limits in (quality_rules.Limits(), quality_rules.Limits(duplicate_ngrams={3: 0.5}, top_ngrams={})):
        found = quality_rules.measure(texts, limits, {})
        for i, text in enumerate(texts):
            base, (repetition, symbols) = base_figures(text), excesses(text, limits)
            assert base == tuple(found[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
            assert abs(found["repetition"][i] - repetition) < 1e-9 and abs(found["symbols"][i] - symbols) < 1e-9
            assert found["kept"][i] == (not base[-1] and found["repetition"][i] <= 1 and found["symbols"][i] <= 1)
        kept += sum(found["kept"])
    assert 0 < kept < 2 * len(texts)


def test_shares_are_of_characters():
    """A repeated run in a script of two bytes a letter weighs what its letters do: 0.14 of this text (0.22 of its bytes), under the limit of 0.2."""
    rng = random.Random(7)
    run = " ".join("".join(rng.choices("абвгдежз", k=6)) for _ in range(12))
    rest = " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(60))
    assert quality_rules.measure([f"{run} {rest} {run}"], quality_rules.Limits(), {})["kept"][0]


def test_rules_on_odd_rows(spark):
    docs = documents(spark)
    rows = quality_rules.measure_documents(docs, keep=["doc_id", "n_words"]).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == Counter((i, *base_figures(t)) for i, t in TEXTS)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert kept.count() == sum(r["kept"] for r in rows)
    assert quality_rules.measure_documents(documents(spark, [])).collect() == []


def test_rules_keep_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.measure_documents(docs, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    long = rows[~rows.base_failed]
    assert long[long.quality == 1].kept.mean() > 0.99
    assert rows[rows.quality == 0].kept.mean() < 0.05


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n1 = y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("op, label, least, accuracy", [(toxicity.op6_toxicity, "toxic", 0.97, 0.97), (quality_classifier.op7_quality_classifier, "quality", 0.98, 0.97)])
def test_held_out_accuracy(spark, op, label, least, accuracy):
    found = op(spark, "/root/testdata/sf0.1").toPandas()
    assert found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    rows = found[found.held_out].merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    assert auc(rows[label].to_numpy(), rows.score.to_numpy()) > least
    assert (rows.predicted == rows[label]).mean() > accuracy


def test_held_out_labels_are_never_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    for module in (toxicity, quality_classifier):
        a, b = (module.score(docs, module.fit(docs, x), keep=["doc_id"]).toPandas().set_index("doc_id").score for x in (labels, flipped))
        assert a.sort_index().equals(b.sort_index())


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_classifiers_on_odd_rows(spark, module):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (3, 0, 0), (4, None, None), (None, 1, 1), (99, 1, 0), (7, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        model = module.fit(docs, labels)
        rows = module.score(docs, model)
        assert set(rows.columns) == set(docs.columns) and dict(rows.dtypes)["score"] == "double"
        got = [r["score"] for r in rows.collect()]
        assert len(got) == len(TEXTS) and all(0 <= x <= 1 for x in got)
        assert module.score(documents(spark, []), model).collect() == []
    kept = quality_classifier.filter_documents(docs, quality_classifier.fit(docs, some))
    assert kept.dtypes == docs.dtypes


def test_sample_is_bounded_and_split(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'x' as text").union(spark.range(5000).selectExpr("id % 7 as doc_id", "'y' as text"))
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as quality")
    rows = labelled.labelled_sample(docs, labels.union(labels), "quality", 100).collect()
    assert Counter((r["label"], r["turn"]) for r in rows) == {(k, t): 50 for k in (0, 1) for t in (0, 1)}
    assert len({r["doc_id"] for r in rows}) == 200
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def ftrl(examples, bits):
    """The published per-coordinate update, a coordinate at a time."""
    z, n, alpha, beta, l2 = {}, {}, toxicity.ALPHA, toxicity.BETA, toxicity.L2

    def weight(i):
        l1 = 0.0 if i == 1 << bits else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for coordinates, label, importance in examples:
        w = {i: weight(i) for i in coordinates}
        p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
        for i in coordinates:
            g = importance * (p - label)
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def toxic_examples():
    rng, hashes = np.random.default_rng(2), toxicity.Hashes()
    texts = [" ".join([f"w{x}" for x in rng.integers(0, 300, 40)] + (["awful"] if k % 2 else [])) for k in range(400)]
    return [(toxicity.coordinates(t, hashes), k % 2, 1.0 + k % 3) for k, t in enumerate(texts)]


def test_ftrl_finds_what_matters():
    model = toxicity.learn(iter(toxic_examples() * 5))
    assert 0 < len(model.at) < 5_000  # sparse
    table = np.zeros((1 << toxicity.BITS) + 1, dtype=np.float32)
    table[model.at] = model.weight
    bad, good = toxicity.score_texts(["some awful text w1", "some text w1"], table, toxicity.Hashes())
    assert bad > 0.5 > good


def test_ftrl_against_single_steps():
    examples = toxic_examples() * 2
    want = ftrl([(c.tolist(), y, w) for c, y, w in examples], toxicity.BITS)
    model = toxicity.learn(iter(examples))
    assert model.at.tolist() == sorted(want)
    assert np.allclose(model.weight, [want[i] for i in sorted(want)], rtol=1e-4)


def test_toxicity_of_a_text_against_its_words():
    """Features counted word by word: a score is the logistic of the weights of the distinct features."""
    mask = (1 << 64) - 1
    text = "You awful, AWFUL people; go (away) now awful"
    words = [w.lower().strip(toxicity.EDGES) or w for w in text.split()]
    h = [xxhash.xxh64_intdigest(w) for w in words]
    found = {x >> 64 - toxicity.BITS for x in h} | {xxhash.xxh64_intdigest(w[: toxicity.STEM], 1) >> 64 - toxicity.BITS for w in words}
    for d, m in toxicity.PAIRS.items():
        found |= {((a * m + b) * toxicity.PAIRS[1] & mask) >> 64 - toxicity.BITS for a, b in zip(h, h[d:])}
    assert toxicity.coordinates(text, toxicity.Hashes()).tolist() == [*sorted(found), 1 << toxicity.BITS]
    table = np.random.default_rng(3).normal(size=(1 << toxicity.BITS) + 1).astype(np.float32)
    want = 1 / (1 + math.exp(-sum(float(table[i]) for i in [*found, 1 << toxicity.BITS])))
    assert abs(toxicity.score_texts(["x", text, ""], table, toxicity.Hashes())[1] - want) < 1e-6


def test_quality_score_against_sizes(spark):
    """Sizes from compressors of the test's own, and the regression's formula written out."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.score(docs, model, keep=["doc_id", "text"]).limit(200).collect()
    for r in rows:
        data = (r["text"] or "").encode()
        sizes = [len(zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_dict_id=False, write_checksum=False).compress(data)) for x in (model.good, model.bad)]
        n = len(data) + 16
        own = [(sizes[1] - sizes[0]) / n, math.log((min(sizes) + 8) / n), math.log(n)]
        x = [max(-4.0, min(4.0, (a - c) / s)) for a, c, s in zip(own, model.centre, model.scale)]
        total = sum(w * a for w, a in zip(model.weights, [1, *x, *(a * a for a in x), x[0] * x[1], x[0] * x[2], x[1] * x[2]]))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9


def test_long_and_repeated_texts_take_nothing_from_the_fit(spark):
    """A text of 40 million characters and an id of very many rows leave the other labelled texts in the sample."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["fine", "calm", "good", "tea"] if i % 2 else ["vile", "hate", "scum", "rot"], k=30))) for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    long = spark.range(1).selectExpr("1000L as doc_id", "repeat('calm tea ', 4500000) as text")
    many = spark.range(20_000).selectExpr("3L as doc_id", "'fine good calm tea fine good' as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(1 - doc_id % 2 as int) as toxic").union(spark.sql("select 1000L, 1, 0"))
    test = spark.createDataFrame([(1, "hate rot vile scum hate"), (2, "calm good tea fine calm")], "doc_id long, text string")
    for module, way in ((toxicity, 1), (quality_classifier, -1)):
        score = {r["doc_id"]: r["score"] for r in module.score(test, module.fit(docs.union(long).union(many), labels)).collect()}
        assert (score[1] - 0.5) * way > 0 > (score[2] - 0.5) * way
