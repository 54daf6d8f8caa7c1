"""Shapes and k-mers of strands from the bytes of texts: what the strands' letters give."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import least_squares as L
from strandlake.plans import base as B

RNG = np.random.default_rng(1)
TEXTS = [None, "", "a", "é" * 50, "U" * 100, "\x00" * 61, "ªªª" * 30, *("".join(map(chr, RNG.choice([65, 85, 0, 97, 170, 255, 0x20AC], RNG.integers(0, 120)))) for _ in range(60))]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(["x", "y", None][i % 3], t) for i, t in enumerate(TEXTS)], "group string, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def cut(texts):
    return [tuple(r) for r in B.strands(texts).collect()]


def test_shapes_equal_those_of_letters(texts, cut):
    shape = lambda s: (max(map(len, re.findall("A+|C+|G+|T+", s))), sum(c in "GC" for c in s), len(s))
    assert Counter(map(tuple, B.strand_shapes(texts).collect())) == Counter((g, i, *shape(s)) for g, i, s in cut)
    counts = B.shape_counts(texts).collect()
    assert {tuple(r)[:4]: r.n for r in counts} == Counter((g, *shape(s)) for g, _, s in cut) and len(counts) == len({tuple(r)[:4] for r in counts})


def test_rows_that_stand_for_several(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3), (0, 2.0, 5.0, 1), (0, 4.0, 5.0, 2)], "g int, a double, y double, times int")
    each = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times"))))
    features = {"one": F.lit(1.0), "a": F.col("a")}
    got, plain = L.fit(df, ["g"], features, F.col("y"), F.col("times")).first(), L.fit(each, ["g"], features, F.col("y")).first()
    assert got.n == plain.n == 6 and np.allclose(got.weights, plain.weights)


def test_kmers_equal_those_of_letters(texts, cut):
    expected = Counter((g, k, s[i : i + k]) for g, _, s in cut for k in (1, 2, 3, 4, 5) for i in range(len(s) - k + 1))
    assert {(r["group"], r.k, r.kmer): r.n for r in B.text_kmer_counts(texts, (1, 2, 3, 4, 5)).collect()} == expected
    with pytest.raises(Exception, match="within two bytes"):
        B.text_kmer_counts(texts, (6,)).collect()
