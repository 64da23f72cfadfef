import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import spelling

from .cases import TEXTS, documents


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=199, least=5):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                count[word] += 1
    words = {w: n for w, n in count.items() if n >= least}
    forms, found = {}, {}
    for w, n in words.items():
        own = [x for x in words if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None
        found[w] = (n, len(own))
    rows = set()
    for w, (n, n_near) in found.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, n_near, words.get(forms[w])))
    return rows


def made_up(n=300):
    rng = random.Random(8)
    letters = "abcdeéßÿ÷×À"
    base = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "aabbaabb", "aabaabb"]
    weights = [rng.choice([1, 3, 20, 200]) for _ in base]
    rows = []
    for i in range(n):
        words = []
        for w in rng.choices(base, weights, k=60):
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :]])
            words.append(w.title() if rng.random() < 0.2 else w)
        rows.append((i if i % 40 else None, rng.choice([" ", ", ", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("every, most", [(199, spelling.MOST_BROADCAST), (3, 128)])
def test_groups_equal_brute_force(spark, every, most):
    rows = made_up() + [(i, t) for i, t in TEXTS]
    want = brute(rows, every)
    assert len({r[2] for r in want} - {r[0] for r in want if r[1] is None}) == 0 and any(r[1] for r in want)
    got = spelling.group_variants(documents(spark, rows).repartition(3), every=every, most_broadcast=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_whole_query_on_a_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert set(map(tuple, spelling.op13_spelling(spark, "/root/testdata/sf0.001").collect())) == brute(rows)


def test_chains_and_ties(spark):
    words = {"aaaaaaab": 5, "aaaaaaaa": 25, "aaaaaaac": 25, "aaaaaaa": 125, "aaaaaa": 3000, "xaaaaa": 15000, "bbbbbb": 5, "bbbbbbc": 24, "ccccccc": 5, "cccccc": 25, "cccccccc": 25}
    rows = [(None, " ".join([w] * n)) for w, n in words.items()]
    got = {r.word: r for r in spelling.group_variants(documents(spark, rows), every=10**12).collect()}
    assert set(map(tuple, got.values())) == brute(rows, 10**12)
    assert got["aaaaaaab"].root == "xaaaaa" and got["bbbbbb"].form is None and got["ccccccc"].form == "cccccc"


def test_empty_and_wordless_tables(spark):
    assert spelling.group_variants(documents(spark, [])).collect() == []
    assert spelling.group_variants(documents(spark, [(1, None), (2, ""), (3, "short words only")])).collect() == []
    long = "é" * 3000
    got = spelling.group_variants(documents(spark, [(1, f"{long} " * 6 + f"{long}a " * 40)]), every=10**12).collect()
    assert {(r.form and len(r.form), r.n, r.n_near, r.form_n) for r in got} == {(3001, 6, 1, 40), (None, 40, 1, None)}


def test_long_texts_are_listed_in_steps(spark, monkeypatch):
    monkeypatch.setattr(spelling, "AT_ONCE", 100)
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    rows = made_up(60)
    assert set(map(tuple, spelling.group_variants(documents(spark, rows)).collect())) == brute(rows)


def test_filters_miss_nothing():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(3000)]
    (_, _, letters), = spelling.by_length(words)
    h, blocks = spelling.word_hashes(letters), 94
    lanes = np.zeros((blocks, 8), dtype=np.uint64)
    for k in range(spelling.BITS):
        bit = spelling.bit_of(h, k)
        np.bitwise_or.at(lanes, (spelling.blocks_of(h, blocks).astype(int), (bit >> np.uint64(6)).astype(int)), np.uint64(1) << (bit & np.uint64(63)))
    assert len(spelling.passes(lanes.reshape(-1), 0, blocks, h)) == len(h)
    other = spelling.mixed(np.arange(100_000, dtype=np.uint64))
    assert len(spelling.passes(lanes.reshape(-1), 0, blocks, other)) < 1000
    parts = [spelling.passes(lanes[a:b].reshape(-1), a, blocks, h) for a, b in ((0, 40), (40, 94))]
    assert sorted(np.concatenate(parts).tolist()) == [*range(len(h))]
