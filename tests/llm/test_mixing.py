import random
import re
from collections import Counter, defaultdict

import pytest

from cadenza.llm import mixing

from .cases import TEXTS, documents


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """By source, sources in order: shares by weight, what is above a source's bound going to the others again and again."""
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        still = [s for s in sizes if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in still) for s in still}
        above = {s for s in still if share[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in stopped else share[s] for s in sizes}
        stopped |= above


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, number int, target int, p int, key string, copies int")


def made_up(spark, n=6000):
    rng = random.Random(3)
    sources = ["hot"] * 12 + ["", "a", "Z", "é", "日本", "tiny", None, "b"]
    rows = []
    for i in range(n):
        source = rng.choice(sources)
        words = 1 if source == "tiny" else rng.choice([0, 1, 3, 8, 20, 50, rng.randint(1, 400)])
        rows.append((i if i % 50 else None, " \t".join(["wörd"] * words) if rng.random() > 0.02 else None, source, "x", 1, 2, 3, "k", 4))
    rows += [rows[1]] * 40
    return rows_of(spark, rows), rows


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 50)
    monkeypatch.setattr(mixing, "FAN", 4)  # several levels
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 3)
    docs, rows = made_up(spark)
    mixed = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in mixed) == Counter((r[0], r[2], size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    sizes = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}
    want, taken, longest = brute_targets(sizes), defaultdict(int), defaultdict(int)
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        share = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r["size"] <= 3 * r["size"] and (r["size"] == 0 or r.copies in (int(share), int(share) + 1))
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    assert any(want[s] == 3 * sizes[s] for s in sizes)  # "tiny" is at its bound
    for s in sizes:
        assert abs(taken[s] - want[s]) < max(1, longest[s])
    again = mixing.mix(docs.repartition(7, "text")).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, mixed))


def test_pivot_keeps_words_and_expectations():
    rng = random.Random(5)
    for _ in range(2000):
        p, q, s, t = rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99), rng.randint(1, 1000), rng.randint(1, 1000)
        ends = [mixing.pivot(p, s, q, t, u) for u in (0.0, 1.0)]
        for a, b in ends:
            assert 0 <= a <= 1 and 0 <= b <= 1 and (a in (0, 1) or b in (0, 1))
            assert a * s + b * t == pytest.approx(p * s + q * t)
        chance = (p - ends[1][0]) / (ends[0][0] - ends[1][0])  # of the first, for the expectation to stay
        below, above = mixing.pivot(p, s, q, t, chance - 1e-6), mixing.pivot(p, s, q, t, chance + 1e-6)
        assert below == ends[0] and above == ends[1]


def test_expected_copies(spark):
    docs = rows_of(spark, [(i, "w " * (1 + i % 7), "s", "", 1, 2, 3, "", 4) for i in range(40)] + [(100 + i, "w " * 30, "t", "", 1, 2, 3, "", 4) for i in range(40)])
    times, taken = 12, Counter()
    for seed in range(times):
        for r in mixing.mix(docs, weights=(1.0, 1.0), seed=seed).collect():
            taken[r.doc_id // 100] += r.copies
            share = r.target / r.source_size
            assert r.copies in (int(share), int(share) + 1)
    one = mixing.mix(docs, weights=(1.0, 1.0)).filter("doc_id < 100").first()
    assert taken[0] / (40 * times) == pytest.approx(one.target / one.source_size, rel=0.05)


def test_edge_tables(spark):
    assert mixing.mix(rows_of(spark, [])).collect() == []
    empty = mixing.mix(rows_of(spark, [(1, None, "a", "", 1, 2, 3, "", 4), (2, "", None, "", 1, 2, 3, "", 4)])).collect()
    assert {(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in empty} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    same = mixing.mix(rows_of(spark, [(None, "a b c", "a", "", 1, 2, 3, "", 4)] * 30 + [(5, "d e", "b", "", 1, 2, 3, "", 4)] * 30)).collect()
    assert len(same) == 60 and abs(sum(r.taken for r in same) - 150) <= 3
    assert mixing.mix(documents(spark)).count() == len(TEXTS)


def test_repeated(spark):
    docs = rows_of(spark, [(i, "w " * (1 + i % 5), "st"[i % 2], "", 1, 2, 3, "", 4) for i in range(50)])
    mixed = mixing.mix(docs)
    want = {r.doc_id: r.copies for r in mixed.collect() if r.copies}
    assert Counter(r.doc_id for r in mixing.repeated(docs, mixed).collect()) == want
