"""Checksums, frames and neighbours as columns, against the standard library and plain versions."""

import binascii
import random
from bisect import bisect_left

from pyspark.sql import functions as F

from strandlake.functions import frames as R
from strandlake.operators import fountain as L


def test_crc16_equals_binascii(spark):
    rng = random.Random(1)
    rows = [(i, bytearray(rng.randbytes(n))) for i, n in enumerate([0, 1, 2, 3, 20, 255, 256, 5000] * 4)] + [(99, None)]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, b binary").select("i", R.crc16(F.col("b")).alias("c")).collect()}
    assert got == {i: b if b is None else binascii.crc_hqx(bytes(b), 0xFFFF) for i, b in rows}


def test_frames_come_back_and_say_why_not(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(1 << 20), rng.randbytes(16).hex()) for _ in range(200)] + [(0, "00" * 16), ((1 << 20) - 1, "ff" * 16)]
    df = spark.createDataFrame(rows, "seed long, value string").select("*", R.framed(F.col("seed"), F.col("value"), 16).alias("s"))
    back = df.select("seed", "value", "s", R.parsed(F.col("s"), 16, 1 << 20).alias("p")).collect()
    assert all(r.p.reason is None and r.p.seed == r.seed and r.p.value == r.value and len(r.s) == 88 for r in back)
    s = back[0].s
    other = {"A": "C", "C": "A", "G": "T", "T": "G"}
    odd = [(None, "length"), ("", "length"), (s[:-1], "length"), (s + "A", "length"), ("N" + s[1:], "letter"), (s[:-1] + "a", "letter"), (other[s[0]] + s[1:] if s[0] in "ACG" else "C" + s[1:], "seed"), (s[:40] + other[s[40]] + s[41:], "checksum"), (s[:-1] + other[s[-1]], "checksum")]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(odd)], "i int, s string").select("i", R.parsed(F.col("s"), 16, 1 << 20).alias("p")).orderBy("i").collect()
    assert [r.p.reason for r in got] == [w for _, w in odd] and all(r.p.seed is None and r.p.value is None for r in got)


def test_neighbours_equal_plain(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 7, 60)], "n int")
    cdfs = {r.n: r.cdf for r in L.soliton_table(sizes).collect()}
    assert all(abs(a - b) < 1e-8 for n in (2, 7, 60) for a, b in zip(cdfs[n], L.soliton_weights(n)))
    u = F.expr("conv(substring(md5(cast(concat_ws('|', seed, n, k) as binary)), 1, 8), 16, 10) / 4294967296.0D")
    df = spark.range(120).withColumnRenamed("id", "seed").crossJoin(L.soliton_table(sizes))
    got = df.select("seed", "n", R.neighbours(F.col("seed"), F.col("n"), F.col("cdf")).alias("c")).collect()
    keys = df.select("seed", "n", F.explode(F.concat(F.array(F.lit("degree")), F.sequence(F.lit(0), F.col("n")).cast("array<string>"))).alias("k")).select("seed", "n", "k", u.alias("u"))
    draws = {(r.seed, r.n, r.k): r.u for r in keys.collect()}
    for r in got:
        degree = min(bisect_left(cdfs[r.n], draws[r.seed, r.n, "degree"]) + 1, r.n)
        chosen = set()
        for j in range(r.n - degree, r.n):
            t = int(draws[r.seed, r.n, str(j)] * (j + 1))
            chosen.add(j if t in chosen else t)
        assert r.c == sorted(chosen) and len(r.c) == degree
