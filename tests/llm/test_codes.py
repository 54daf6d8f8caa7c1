"""Vector codes against plain k-means, the bounds themselves, and odd rows."""

import numpy as np
import pytest

from strandlake.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, Code string"


def plain(vectors, parts, k, rounds):
    """Codebooks, codes and errors of vectors in the order of their ids, with every distance in every round, one at a time."""
    whole = [[int(np.floor(codes.SCALE * v)) for v in x] for x in vectors]
    w = len(whole[0]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for x in whole]
    books = [[cut[i][p] for i in range(min(k, len(cut)))] for p in range(parts)]

    def far(a, b):
        return sum((u - v) ** 2 for u, v in zip(a, b))

    for r in range(rounds + 1):
        own = [[min(range(len(books[p])), key=lambda e: (far(x[p], books[p][e]), e)) for p in range(parts)] for x in cut]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [x[p] for x, o in zip(cut, own) if o[p] == e]
                    if mine:
                        books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    return books, own, [sum(far(x[p], books[p][o[p]]) for p in range(parts)) for x, o in zip(cut, own)]


@pytest.mark.parametrize("group", [1, 3, 16])
def test_equals_plain(spark, group):
    rng = np.random.default_rng(group)
    x = rng.normal(size=(300, 12)).round(2)
    x[40:90] = x[0:50]  # ties
    df = spark.createDataFrame([(i, v.tolist(), int(i % 3) if i % 4 else None, "z") for i, v in enumerate(x)], SCHEMA).repartition(5)
    rows, books = codes.compress(df, parts=4, entries=7, rounds=5, group=group)
    want, own, errors = plain(x, 4, 7, 5)
    assert books.tolist() == want
    got = {r.vec_id: r for r in rows.collect()}
    assert [got[i].codes for i in range(300)] == own and [got[i].error for i in range(300)] == errors
    scans = sum(r.scans for r in got.values())
    assert scans < 300 * 4 * 7 * 6
    # the looser bounds give the same with at least as many distances
    loose, same = codes.compress(df, parts=4, entries=7, rounds=5, group=group, moves=codes.drifted)
    assert (same == books).all() and loose.groupBy().sum("scans").first()[0] >= scans
    labels = {}
    for i, e in enumerate(errors):
        labels[int(i % 3) if i % 4 else None] = labels.get(int(i % 3) if i % 4 else None, 0) + e
    for r in codes.digest(rows, books).collect():
        assert r.label_error == labels[int(r.vec_id % 3) if r.vec_id % 4 else None] and r.code == "".join(f"{c:02x}" for c in own[r.vec_id])
    near = codes.decode(rows, books).orderBy("vec_id").first().decoded
    assert len(near) == 12 and abs(sum((a - b) ** 2 for a, b in zip(near, x[0])) - errors[0] / codes.SCALE**2) < 0.02


def test_bounds_hold_and_net_moves_are_tighter():
    rng = np.random.default_rng(4)
    history = rng.integers(-900, 900, (6, 16, 8)).cumsum(0)
    x = rng.integers(-2000, 2000, (500, 8))
    part = codes.Part.first(x, history[0], 4)
    for now in range(1, 6):
        assert (codes.net(history, now, 4) <= codes.drifted(history, now, 4) * (1 + 1e-9)).all()
        lowered = part.bound * (1 - codes.NARROW) - np.take_along_axis(codes.net(history, now, 4), part.stamp, 0)
        d = codes.squared(x, history[now]).astype(float)
        d[np.arange(500), part.own] = np.inf
        assert (lowered <= np.sqrt(d).reshape(500, 4, 4).min(2)).all()
        part.step(history, now, 4)
        assert (part.own == codes.squared(x, history[now]).argmin(1)).all()
        assert part.stamp.max() <= now and (part.stamp < now).any() or now < 2


def test_odd_rows(spark):
    v = [1.0, 2.0, -0.5, 0.25]
    odd = [(1, None, 1, ""), (2, [1.0, None, 0.0, 0.0], 1, ""), (3, [float("nan")] * 4, 1, ""), (4, [float("inf"), 0.0, 0.0, 0.0], 1, ""), (5, [], 1, ""), (0, [1.0] * 3, 1, "")]
    good = [(9, v, None, ""), (9, v, None, ""), (7, [0.0] * 4, 1, ""), (None, [5.0] * 4, None, ""), (8, [1.0] * 8, 1, "")]
    rows, books = codes.compress(spark.createDataFrame(odd + good, SCHEMA), parts=2, entries=16, rounds=2)
    got = sorted(codes.digest(rows, books).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    assert [(r.vec_id, r.error, r.label_error) for r in got] == [(7, 0, 0), (9, 0, 0), (9, 0, 0), (None, 0, 0)]
    assert books.shape == (2, 4, 2) and [r.code for r in got] == ["0000", "0101", "0101", "0303"]
    rows, books = codes.compress(spark.createDataFrame([], SCHEMA))
    assert codes.digest(rows, books).count() == 0 and books.size == 0
    long = spark.createDataFrame([(i, [float(i + j) for j in range(8000)], 1, "") for i in range(20)], SCHEMA)
    rows, _ = codes.compress(long, rounds=1)
    assert rows.count() == 20
    with pytest.raises(Exception, match="can't be compressed"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1, "")], SCHEMA))
