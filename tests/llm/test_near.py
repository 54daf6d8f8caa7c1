"""Near-duplicate texts and vectors against brute force, with edge cases."""

import math
import random
import re

import numpy as np
import pytest

from strandlake.llm import minhash, vectors
from strandlake.llm.common import connected_components
from strandlake.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_shingle_sets_match_words():
    texts = ["A b c d e", "a  B\tc\nd e", "a b", None, "", "   ", "x " * 50, "é ü ß a b", "a b c d e f"]
    got, expected = shingle_sets(texts, 4), [shingles(t, 4) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in expected]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(expected[i] & expected[j])


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("short_list", [40, 3])
def test_components_equal_brute_force(spark, monkeypatch, short_list):
    monkeypatch.setattr(minhash, "SHORT_LIST", short_list)  # with 3, families take the way of long lists
    rng = random.Random(short_list)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts = family(rng, base, 60, 8) + [" ".join(base)] * 5
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(80)) for _ in range(30)]
    texts += ["", None, "one", "one", "two words", "Two  WORDS", "x" * 5000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=4).collect()}
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    expected = components(sets)
    assert got == {i: (len(sets[i]), expected[i], i == expected[i]) for i in sets}


def test_near_duplicates_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (7, None), (3, "a b c d e")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert rows == [(-1, -1, True), (1, 1, True), (1, 1, True), (3, 1, False), (7, 7, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(9, 9)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[:100] + 0.25 * rng.normal(size=(100, 16))
    x[200:240] = x[5] + 0.05 * rng.normal(size=(40, 16))
    x[240:250] = x[7]
    rows = [(i, [float(np.float32(v)) for v in r], int(i % 3 == 0)) for i, r in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [math.nan] * 16, 0), (303, rows[7][1], None), (304, [1.0, 2.0], 0), (305, [], 0)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    links = set()
    for i, a, la in rows[:300]:
        for j, b, lb in rows[:300]:
            if i < j and la == lb:
                a_, b_ = np.array(a), np.array(b)
                if a_ @ b_ / (np.linalg.norm(a_) * np.linalg.norm(b_)) >= 0.93:
                    links.add((i, j))
    found = sum(got[i].n_links for i in range(300)) / 2
    assert 0.9 * len(links) <= found <= len(links)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(300, 306))


def test_vectors_empty(spark):
    t = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(t).collect()[0].n_links == 0
    assert vectors.near_vectors(t.limit(0)).count() == 0


@pytest.mark.parametrize("short_list,group", [(40, 2), (1, 3)])
def test_links_at_exactly_the_threshold_are_found(spark, monkeypatch, short_list, group):
    monkeypatch.setattr(minhash, "SHORT_LIST", short_list)
    rng = random.Random(group)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts, links = [], 0
    for _ in range(150):
        d = rng.randint(1, 40)  # 8 d shingles in common, d of each text's own: 8 d of 10 d
        common = [word() for _ in range(8 * d + 3)]
        texts += [" ".join(common + [word() for _ in range(d)]) for _ in range(group)]
        links += group - 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = minhash.near_duplicates(docs, words=4).collect()
    assert all(r.component_id == r.doc_id // group * group for r in got) and sum(not r.kept for r in got) == links


@pytest.mark.parametrize("k", [32, 256, 1024, 2048])
def test_recall_of_vectors_that_codebooks_were_not_fitted_to(monkeypatch, k):
    """Partners at exactly the least similarity of fresh vectors, for an index of as many vectors as have k codes; a pair is found from either side."""
    monkeypatch.setattr(vectors, "PASSES", 3)
    rng = np.random.default_rng(k)
    count, centres = (8 * k) ** 2, rng.normal(size=(300, 32))
    assert vectors.codes_for(count) == k

    def drawn(n):
        return np.concatenate([rng.normal(size=(n // 2, 32)), centres[rng.integers(0, 300, n - n // 2)] + 0.5 * rng.normal(size=(n - n // 2, 32))])

    index = vectors.Index(drawn(vectors.sample_rows(count)), count, 0.93)
    x = drawn(800)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    (own, seen), (other, theirs) = index.cells(x), index.cells(y)
    met = (seen == other[:, None]).any(1) | (theirs == own[:, None]).any(1)
    assert met.mean() >= 0.95
