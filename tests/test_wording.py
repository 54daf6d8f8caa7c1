"""Numbers, settings and findings as text against Python's own formatting and sentences by hand."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import strands as S
from strandlake.functions import wording as W


def test_numbers_as_text(spark):
    rng = random.Random(2)
    xs = [0.0, 0.25, 0.35, 2.5, 3.5, 0.125, 1.005, 0.01, 0.00999, 0.0099499, 0.001, 0.00095, 0.0009951, 0.0001, 0.00009951, 0.0000994, 2.1e-6, 2e-6, 9.96e-6, 1e-12, 12345678.9, 1.0]
    xs += [rng.random() * 10 ** rng.randint(-7, 4) for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    x = F.col("x")
    got = df.select("i", W.fixed(x, 1).alias("a"), W.fixed(-x, 2, signed=True).alias("b"), W.percent(x).alias("p"), W.small(x).alias("s")).orderBy("i").collect()
    for r, v in zip(got, xs):
        small = f"{v:.2f}" if v >= 0.01 or v == 0 else f"{v:.2g}"
        assert (r.a, r.p, r.s) == (f"{v:.1f}", f"{v:.0%}", small)
        assert r.b == f"{-v:+.2f}"


def test_nulls_have_words(spark):
    none = F.lit(None).cast("double")
    r = spark.range(1).select(W.share_setting(none), W.risk_setting(none), W.whole_setting(none), W.gc_setting(none, none), W.gc_setting(none, F.lit(0.6)), W.gc_setting(F.lit(0.4), none), W.reads_text(none)).first()
    assert tuple(r) == ("off", "off", "off", "off", "0 to 60%", "40 to 100%", "target not met")


def test_changes_keep_their_order(spark):
    new = {"run": "off", "spare": "35%", "gc": "40 to 60%", "risk": "risk ≤ 0.02"}
    old = {"run": "3", "spare": "30%", "gc": "40 to 60%", "risk": "off"}
    got = spark.range(1).select(W.changes([(k, F.lit(old[k]), F.lit(new[k])) for k in old]).alias("c")).first().c
    assert got == ["run switched off", "spare 30% → 35%", "risk on (risk ≤ 0.02)"]


@pytest.mark.parametrize("rule,name", [
    (" max_homopolymer = 4 ", "No run of more than 4 identical letters"), ("gc 0.35 - 0.65", "G+C share between 35% and 65%"), ("redundancy 1 vs tuned", "Fixed 100% spare strands"),
    ("tuned codec vs default", "Tuned codec vs default"), ("max_homopolymer=x", "max_homopolymer=x"), ("", ""),
])
def test_rule_names(spark, rule, name):
    assert spark.createDataFrame([(rule,)], "r string").select(W.rule_name(F.col("r"))).first()[0] == name


@pytest.mark.parametrize("numbers,text", [
    ((2.0, 0.72, 6.0, 1.5), "needs 2.0 reads instead of 6.0 but stores 52% less per letter (0.72 vs 1.50 bits per base)."), ((None, 1.5, 6.0, 1.5), "never reaches the recovery target and at the same density."),
    ((3.0, 2.0, None, 1.0), "reaches the target at 3.0 reads where B never does and stores 100% more per letter (2.00 vs 1.00 bits per base)."), ((3.0, None, 3.04, 1.0), "needs the same 3.0 reads as B."),
    ((None, 2.0, None, 1.0), "never reaches the recovery target but stores 100% more per letter (2.00 vs 1.00 bits per base)."), ((4.0, 1.0, 3.0, 0.0), "needs 4.0 reads instead of 3.0."),
])
def test_trades(spark, numbers, text):
    df = spark.createDataFrame([numbers], "r double, x double, q double, y double")
    got = df.select(W.trade(F.lit("c"), F.lit("A"), F.col("r"), F.col("x"), F.lit("B"), F.col("q"), F.col("y"))).first()[0]
    assert got == f"On c, A {text}"


@pytest.mark.parametrize("numbers,text", [
    ((-0.01, -0.002, -0.02), "The learned scorer cuts strand failures by 1.00 points (95% CI 0.20 to 2.00 points)."), ((0.01, 0.002, 0.02), "The learned scorer raises strand failures by 1.00 points (95% CI 0.20 to 2.00 points)."),
    ((0.0, -0.01, 0.02), "No measurable difference in strand failures (95% CI -1.00 to +2.00 points)."), ((0.01, 0.0, 0.02), "No measurable difference in strand failures (95% CI +0.00 to +2.00 points)."),
])
def test_paired_findings(spark, numbers, text):
    df = spark.createDataFrame([numbers], "d double, a double, b double")
    assert df.select(W.paired_finding(*map(F.col, "dab"))).first()[0] == text


def test_effects_of_rules(spark):
    rows = [("max_homopolymer=3", 8.5, 12.0, 1.5, 1.6), ("gc 0.4-0.6", 8.5, 8.52, 1.5, 1.502), ("redundancy 0.3 vs tuned", None, 3.0, None, 1.6), ("tuned codec", 6.0, None, 1.5, 1.5), ("tuned codec", 6.0, 2.0, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, a double, b double, x double, y double")
    got = [r.e for r in df.select("i", W.rule_effect(*map(F.col, "rabxy")).alias("e")).orderBy("i").collect()]
    assert got == [
        "Switching this rule off: reads needed 8.5 to 12.0, bits per base 1.50 to 1.60", "Switching this rule off: reads needed stay at 8.5", "With the tuned value instead: reads needed target not met to 3.0",
        "Reads needed at 1.50 bits per base: default rules 6.0, tuned codec target not met", "Reads needed: default rules 6.0, tuned codec 2.0"]


def test_names_of_steps(spark):
    rows = [("tier1", 0), ("alternation 0", 1), ("alternation1", 1), ("alternation 2", 2), (" ", 0), (None, 0), ("other", 3), ("alternation 00", 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, n int").coalesce(1).select(W.stage_name(F.col("s"), F.col("n"))).collect()]
    assert got == ["C: rules audited", "D: + learned", "E: loop", "E: loop 2", None, None, "other", "D: + learned"]


def test_channels_of_odd_strands(spark):
    rows = [(0, ""), (1, "A"), (2, "ACGTN"), (3, "G" * 9)]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, s string").select("i", S.channels(F.col("s"), 6).alias("x")).collect()}
    for i, s in rows:
        assert [x.pos for x in got[i]] == list(range(6))
        for x in got[i]:
            inside = x.pos < len(s)
            assert (x.a, x.c, x.g, x.t) == tuple(int(inside and s[x.pos] == b) for b in "ACGT") and x.mask == inside
            assert x.place == (x.pos / max(1, len(s) - 1) if inside else 0)
