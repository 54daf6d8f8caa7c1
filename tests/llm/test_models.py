"""Classifier, mixing and secret rules against plain computations."""

import itertools
import math
import random
import re

import numpy as np

from strandlake.llm import mixing, quality, secret_scan, vectors


def test_fit_equals_plain_ratios_and_is_optimal(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde " if i % 3 else "cdefg !") for _ in range(rng.randint(0, 60))) for i in range(45)]
    labels = [int(i % 3 != 0) for i in range(45)]
    seen = {}
    real = quality.dual_descent

    def kept(rows, values, y, cost, width, passes):
        seen.update(rows=rows, values=values, y=y, cost=cost, w=real(rows, values, y, cost, width, 2000))
        return seen["w"]

    monkeypatch.setattr(quality, "dual_descent", kept)
    model = quality.fit(texts, labels, 0.5)
    features = [set(f.tolist()) for f in quality.features(texts)]
    n = [labels.count(0), labels.count(1)]
    for f in list(set().union(*features))[:300]:
        counts = [sum(f in s and y == c for s, y in zip(features, labels)) for c in (0, 1)]
        ratio = math.log((counts[1] + 1) / (n[1] + 1)) - math.log((counts[0] + 1) / (n[0] + 1))
        assert abs(model.ratios[f] - ratio**2) < 1e-5 * (1 + ratio**2)
    # no other weights have a smaller sum of half their square and the costs of hinges
    rows, values, y, cost, w = (seen[k] for k in ("rows", "values", "y", "cost", "w"))

    def loss(v):
        return v @ v / 2 + sum(c * max(0.0, 1 - t * (v[f] @ x)) for f, x, t, c in zip(rows, values, y, cost))

    r = np.random.default_rng(0)
    used = np.unique(np.concatenate(rows))
    for scale in (1e-1, 1e-2, 1e-3):
        for _ in range(60):
            d = np.zeros(len(w))
            d[used] = r.normal(size=len(used)) / np.sqrt(len(used))
            assert loss(w) <= loss(w + scale * d) + 1e-6
    for f, x, t in zip(rows[:20], values, y):  # nor along a row
        for step in (-1e-2, 1e-2):
            d = np.zeros(len(w))
            d[f] = step * t * x
            assert loss(w) <= loss(w + d) + 1e-6


def test_scores_of_long_and_empty_texts(spark):
    model = quality.fit(["good words here", "b@d ###"] * 30, [1, 0] * 30, 0.5)
    long = "good words here " * 100000
    d = spark.createDataFrame([(1, long, "x"), (2, None, "y"), (2, "", "y"), (3, long, "z")], "doc_id long, text string, Score string")
    rows = sorted((r[0], r[2]) for r in quality.score(d, model).collect())
    assert rows[1][1] == rows[2][1] and rows[0][1] == rows[3][1] > 0.5 and quality.score(d, model).columns == ["doc_id", "text", "score"]


def test_flight_leaves_expectations():
    rng = random.Random(5)
    p, x = [0.2, 0.5, 0.7, 0.9, 0.35, 0.35], [3, 10, 4, 4, 20, 1]
    total = np.zeros(len(p))
    for _ in range(6000):
        q = mixing.flight(p, x, rng.random)
        assert abs(sum(q) - sum(p)) < 1e-6 and abs(sum(a * b for a, b in zip(q, x)) - sum(a * b for a, b in zip(p, x))) < 1e-6 and sum(0 < v < 1 for v in q) <= 2
        total += q
    assert np.abs(total / 6000 - p).max() < 0.025


def test_landing_holds_words_and_documents():
    rng = random.Random(6)
    for _ in range(300):
        x = [rng.randint(1, 30) for _ in range(6)]
        p = [float(rng.random() < 0.5) for _ in range(4)] + [rng.random(), rng.random()]
        words = sum(rng.random() * v for v in x)
        out = mixing.landing(p, x, words)
        total = lambda c: sum(a * b for a, b in zip(c, x))
        off = abs(total(out) - words)
        assert set(out) <= {0.0, 1.0} and abs(sum(out) - sum(p)) < 2
        # at least as near as the best way to decide the undecided
        assert off <= min(abs(total([*p[:4], *c]) - words) for c in itertools.product((0, 1), repeat=2)) + 1e-9
        # and no exchange of two, nor a single one that holds the number, is nearer
        for flips in itertools.chain(((i,) for i in range(6)), itertools.combinations(range(6), 2)):
            c = [1 - v if i in flips else v for i, v in enumerate(out)]
            if sum(c) == sum(out) or (len(flips) == 1 and abs(sum(c) - sum(p)) <= 1):
                assert abs(total(c) - words) >= off - 1e-9


def test_landing_of_a_whole_block():
    rng = random.Random(8)
    for heavy in (0.5, 0.8):
        x = [int(10 * rng.paretovariate(1 / heavy)) + 1 for _ in range(3000)]
        p = [rng.random() for _ in x]
        q = mixing.flight(p, x, rng.random)
        words = sum(a * b for a, b in zip(p, x))
        out = mixing.landing(q, x, words)
        assert abs(sum(out) - sum(p)) < 2 and abs(sum(a * b for a, b in zip(out, x)) - words) < 1


def test_targets_of_many_sources(spark):
    rng = random.Random(7)
    sizes = {f"s{rng.randrange(10**6):06d}": rng.choice((0, 1, 5, 100, 10000)) for _ in range(400)} | {None: 40}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in over} if over else share
        free = free - over if over else set()
    assert all(abs(got[s] - target[s]) < 1e-6 * (1 + target[s]) for s in names)


def test_further_secret_rules_equal_patterns():
    rules = {"hosting": (r"gh[pousr]_[A-Za-z0-9]+", 40), "chat": (r"xox[abprs]-[A-Za-z0-9-]+", 15), "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0)}
    parts = ["ghp_", "gho_", "xoxb-", "xoxz-", "A1b2C3d4E5f6", "-", "_", " ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "\n", "0" * 40, "eyJ", "."]
    rng, s = random.Random(8), secret_scan.scanner()
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 18)))
        got = [(secret_scan.RULES[r].name, a, b) for a, b, r in s.spans(t)]
        for name, (pattern, least) in rules.items():
            assert [x[1:] for x in got if x[0] == name] == [m.span() for m in re.finditer(pattern, t) if m.end() - m.start() >= least]


def test_secrets_in_long_texts_and_no_rows(spark):
    long = "token = abcdef0123456789 " * 40000
    d = spark.createDataFrame([(1, long, 1), (2, None, 2), (2, None, 2)], "doc_id long, text string, Secret_Spans int")
    rows = sorted((r.doc_id, r.n_assign, r.n_hex) for r in secret_scan.digest(secret_scan.scan(d)).collect())
    assert rows == [(1, 40000, 40000), (2, 0, 0), (2, 0, 0)] and secret_scan.scan(d.limit(0)).count() == 0


def test_vectors_as_doubles_at_the_threshold(spark):
    # in single precision both pairs would be on the other side of 0.93
    a = np.array([1.0, 0.0, 0.0])
    rows = [(0, a.tolist(), 1, "x")]
    for i, c in ((1, 0.93 - 1e-12), (2, 0.93 + 1e-12)):
        rows.append((i, [c, math.sqrt(1 - c * c) * (1 if i == 1 else -1), 0.0], 1, "x"))
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long, n_links string")).collect()}
    assert (got[0].n_links, got[1].n_links, got[2].n_links) == (1, 0, 1) and got[2].component_id == 0 and got[1].kept


def test_index_grows_with_the_table():
    sample = np.random.default_rng(2).normal(size=(3000, 8))
    small, large = vectors.Index(sample, 3000, 0.93), vectors.Index(sample, 40_000_000, 0.93)
    assert len(small.books[0]) < len(large.books[0]) <= vectors.CODES
    x = sample[:50] / np.linalg.norm(sample[:50], axis=1, keepdims=True)
    for index in (small, large):
        own, cells = index.cells(x)
        d = index.distances(x)
        total = (d[0][:, :, None] + d[1][:, None, :]).reshape(50, -1)
        t = min(index.visits, total.shape[1])
        assert np.allclose(np.sort(np.take_along_axis(total, cells, 1), 1), np.sort(total, 1)[:, :t]) and (own == total.argmin(1)).all()
