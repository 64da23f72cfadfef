import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import alignment, tokens

from .cases import TEXTS, documents

A, B = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("piece_bpe_32k.model")


def whole(text):
    """(a ids, b ids, a ends, b ends) of a whole text by the libraries alone; None without tokens."""
    if not text:
        return None
    own, data = alignment.aligner(A, B), (" " + text).encode()
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    a_bytes, b_bytes = [own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return None
    return a, b, [*itertools.accumulate(map(len, a_bytes))], [*itertools.accumulate(map(len, b_bytes))]


def groups_of(found):
    a, b, a_ends, b_ends = found
    parts, i, j = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        k, m = a_ends.index(end) + 1, b_ends.index(end) + 1
        parts.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    return ";".join(parts)


def links_of(found):
    a, b, a_ends, b_ends = found
    starts = [0, *a_ends], [0, *b_ends]
    return [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b_ends[j] and starts[1][j] < a_ends[i]]


def brute(texts):
    found = [whole(x) for x in texts]
    links = [links_of(x) if x else [] for x in found]
    count = Counter(itertools.chain(*links))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for x, own in zip(found, links):
        if x is None:
            rows.append((0,) * 6 + ("",))
            continue
        groups = groups_of(x)
        rows.append((len(x[0]), len(x[1]), groups.count(";") + 1, len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(groups.encode()).hexdigest()))
    return rows, count, best


def odd_texts(n):
    rng = random.Random(4)
    parts = list("aaaab  '  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　é́ßİΣς日本語🙂🧿丂!?.,019²½ǅ\x00\x01<|>▁;){}") + ["<|endoftext|>", "</s>", "<s>", "<unk>", "'s", "   ", "é", "ﬁ", ");\r\n", ";\r", "<0x0A>", " ", " "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)]


def test_units_give_what_whole_texts_give():
    texts = odd_texts(4000)
    block = alignment.Block(alignment.aligner(A, B), True)
    for text, (n_a, n_b, n_groups, n_links, sha, groups, _) in zip(texts, block.add(texts)):
        found = whole(text)
        if found is None:
            assert (n_a, n_b, n_groups, n_links, sha, groups) == (0, 0, 0, 0, "", "")
        else:
            assert groups == groups_of(found) and sha == hashlib.sha256(groups.encode()).hexdigest()
            assert (n_a, n_b, n_links) == (len(found[0]), len(found[1]), len(links_of(found)))


def test_spans_are_refined_by_bytes():
    def ends(spans, sizes, first=(0,)):
        starts = [k in first for k in range(len(sizes))]
        return alignment.token_ends(*(np.array([x[k] for x in spans], dtype=np.int64) for k in (0, 1)), np.array(sizes, dtype=np.int64), np.array(starts, dtype=bool)).tolist()

    assert ends([(0, 1), (1, 4), (1, 4)], [1, 2, 1]) == [1, 3, 4]  # a and two tokens of one character
    assert ends([(0, 1), (1, 1), (1, 1), (1, 4)], [1, 1, 1, 1]) == [1, 2, 3, 4]  # bytes of a character
    assert ends([(0, 1), (1, 4), (1, 4), (4, 5), (5, 8), (5, 8)], [1, 2, 1, 1, 1, 2], (0, 3)) == [1, 3, 4, 5, 6, 8]  # two texts
    assert ends([(0, 2), (2, 3)], [1, 2]) == [1, 3]  # spans that the bytes don't bear out
    assert ends([], []) == []
    every, a, b = alignment.align(np.array([1, 3, 4]), np.array([2, 4]))
    assert every.tolist() == [1, 2, 3, 4] and [*zip(a.tolist(), b.tolist())] == [(0, 0), (1, 0), (1, 1), (2, 1)]


@pytest.mark.parametrize("block", [alignment.BLOCK_CHARS, 500])
def test_alignment_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    rows = [(i, t) for i, t in TEXTS if not t or len(t) < 5000] + [(100 + k, x) for k, x in enumerate(odd_texts(150))]
    want, count, best = brute([t for _, t in rows])
    docs, pairs = alignment.align_documents(documents(spark, rows).repartition(3), A, B)
    assert Counter(map(tuple, docs.collect())) == Counter((i, *x) for (i, _), x in zip(rows, want))
    assert {(r.a, r.b): (r.n, r.is_best) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in count.items()}


def test_alignment_of_long_and_no_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "AT_ONCE", 1000)
    docs, pairs = alignment.align_documents(documents(spark, [(1, "the quick brown fox  jumps\n" * 3000)]), A, B, with_groups=True)
    row, found = docs.first(), whole("the quick brown fox  jumps\n" * 3000)
    assert (row.n_a, row.n_b) == (len(found[0]), len(found[1])) and hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    docs, pairs = alignment.align_documents(documents(spark, []), A, B)
    assert docs.collect() == pairs.collect() == []
    docs, pairs = alignment.align_documents(documents(spark, [(1, None), (None, ""), (3, "▁")]), A, B)
    assert sorted(map(tuple, docs.collect()), key=str) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, None, 3)], key=str)
