"""Probabilities of bases against a plain version."""

import re

from pyspark.sql import functions as F

from strandlake.functions import probabilities as P


def plain(s, end, homopolymer, factors, rates):
    run = [len(m[0]) for m in re.finditer(r"A+|C+|G+|T+", s) for _ in m[0]]
    out = []
    for i, r in enumerate(run):
        ramp = 1 + (end - 1) * i / max(len(s) - 1, 1)
        d, o = (ramp * factors[min(r, len(factors)) - 1], ramp) if factors else (ramp * homopolymer ** (r - 1),) * 2
        p = [rates[2] * d, rates[1] * o, rates[0] * o]
        k = 0.5 / sum(p) if sum(p) > 0.5 else 1
        out.append([x * k for x in p])
    return out


def test_probabilities_equal_plain(spark):
    strands = ["AAACCGTTTTTTA", "", "C", "ACGT" * 20]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strands)], "i int, s string")
    for factors in (None, [1.0, 1.5, 4.0]):
        p = P.cap_probabilities(P.base_probabilities(P.error_multipliers(F.col("s"), 2.5, 1.7, factors), 0.03, 0.02, 0.08))
        for r in df.select("i", p.alias("p")).collect():
            want = plain(strands[r.i], 2.5, 1.7, factors, (0.03, 0.02, 0.08))
            assert len(want) == len(r.p) and all(abs(a - b) < 1e-12 for x, y in zip(want, r.p) for a, b in zip(x, (y.dele, y.ins, y.sub)))
