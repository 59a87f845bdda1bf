"""Near copies at 0.8 of five-word shingles, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import shingles, similar

R = random.Random(23)
WORDS = [f"v{i}" for i in range(3000)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def edited(t, n):
    w = t.split()
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


def test_hashes_in_pieces(monkeypatch):
    texts = [b"", b"  a B\tc d e f", b"A b c d e f", b"x", b"x y", b"  ", b"a b c d e f g", "\u00e9 \u00dc".encode(), b"w" * 5000 + b" tail", b" ".join(b"%d" % i for i in range(3000))]
    words, n = shingles.word_hashes(texts)
    assert n.tolist() == [len(t.split()) for t in texts] and (words[:6] == words[6:12]).all()
    known = dict(zip([w for t in texts for w in t.lower().split()], words.tolist(), strict=True))
    assert len(set(known.values())) == len(known) and [known[w] for t in texts for w in t.lower().split()] == words.tolist()
    monkeypatch.setattr(shingles, "PIECE", 7)
    assert (shingles.word_hashes(texts)[0] == words).all()
    h, m = shingles.shingle_hashes(words, n, 5)
    assert m.tolist() == [max(len(t.split()) - 4, min(len(t.split()), 1)) for t in texts]
    alone = [shingles.shingle_hashes(*shingles.word_hashes([t]), 5)[0].tolist() for t in texts]
    assert [x for a in alone for x in a] == h.tolist()


@pytest.mark.parametrize("two", [False, True])
def test_across_blocks(two):
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.r_[s[2:], r.integers(100, 200, 1).astype(np.uint64)]) for s in sets]
    n = len(sets)
    label, node, block = np.arange(n) // 2, np.arange(n), (np.arange(n) >= 60).astype(int) if two else np.zeros(n, int)
    got = similar.across(label, node, block, sets)
    assert all(similar.alike(sets[a], sets[b]) >= 0.8 and (not two or block[a] != block[b]) for a, b in got)
    want = [(a, b) for a in range(n) for b in range(a) if similar.alike(sets[a], sets[b]) >= 0.8 and (not two or block[a] != block[b])]
    assert want and closure(label, got) == closure(label, want)


def closure(label, pairs):
    of = dict(enumerate(label.tolist()))
    for a, b in pairs:
        x, y = of[a], of[b]
        of = {k: x if v == y else v for k, v in of.items()}
    parts = {}
    for k, v in of.items():
        parts.setdefault(v, []).append(k)
    return sorted(parts.values())


@pytest.mark.parametrize("block", [similar.BLOCK, 500])
def test_groups(spark, block):
    base = [prose(R.randrange(100, 400)) for _ in range(12)]
    data = [(i, prose(R.randrange(1, 200))) for i in range(80)]
    for k, b in enumerate(base):
        data += [(1000 + 20 * k + j, edited(b, R.randrange(0, 8))) for j in range(15)]
    data += [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a  B"), (5, "other text of a known id"), (1000, base[0]), (1000, base[0]), (None, base[1])]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in data], "doc_id long, text string, node string, one_d string").repartition(3)
    got = similar.groups(df, block).collect()
    assert len(got) == len(data)
    sets = [similar.shingle_set((t or "").encode()) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if similar.alike(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    want = {}
    for i in range(len(data)):
        want.setdefault(find(i), set()).add(data[i][0])
    have = {}
    for r in got:
        have.setdefault(r["label"], set()).add(r["doc_id"])
    assert sorted(map(sorted_ids, have.values())) == sorted(map(sorted_ids, want.values()))
    kept = similar.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(want)
    assert similar.one_of_each(df.where("false")).count() == 0
    assert kept.where(F.col("doc_id") == 1000).count() <= 1


def sorted_ids(s):
    return sorted(-1 if x is None else x for x in s)
