"""Least squares, probes, guards, trees of results, position errors: against plain computations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import strands as S
from strandlake.operators import consensus as C
from strandlake.operators import errors as E
from strandlake.operators import least_squares as L
from strandlake.operators import probes as Q
from strandlake.operators.guards import SeedGuard
from strandlake.sources import trees


def test_least_squares_equal_numpy_and_scores_are_clipped(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = x @ [0.5, -1.0, 0.2] + 0.3 + 0.1 * rng.normal(size=400)
    rows = [(int(i % 2), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))] + [(0, 1.0, None, 1.0, 5.0), (0, 1.0, 1.0, float("nan"), 5.0), (2, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, y double").repartition(5)
    features = {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b"), "c": F.col("c")}
    got = {r.g: r for r in L.fit(df, ["g"], features, F.col("y")).collect()}
    for g in (0, 1):
        part = np.column_stack([np.ones(200), x[g::2]])
        assert got[g].n == 200 and np.allclose(got[g].weights, np.linalg.lstsq(part, y[g::2], rcond=None)[0], atol=1e-9)
    assert got[2].weights == [0.0] * 4
    scored = df.where("g = 1").join(L.fit(df, ["g"], features, F.col("y")), "g").select(L.predicted(features, F.col("weights")).alias("s"))
    values = [r.s for r in scored.collect()]
    assert min(values) == 0 and max(values) == 1


def risk(designs):
    """1 for every AAC, and a tenth for each base of the longest run."""
    hits = F.size(F.regexp_extract_all("strand", F.lit("AAC"), F.lit(0)))
    return designs.withColumn("score", hits + S.max_run_length(F.col("strand")) / 10.0)


def test_probes_find_known_effects(spark):
    rng = np.random.default_rng(2)
    plain = "".join("ACGT"[i] for i in rng.permutation(4)) * 20
    strands = spark.createDataFrame([(i, "GT" * 40) for i in range(40)] + [(99, "AC"), (98, "")], "strand_id long, strand string")
    kmers = {r.probe: r for r in Q.effects(Q.kmer_designs(strands, 3), risk).collect()}
    assert len(kmers) == 64 and all(r.n == 40 for r in kmers.values()) and max(kmers.values(), key=lambda r: r.mean).probe == "AAC" and kmers["AAC"].mean >= 1
    runs = {r.probe: r for r in Q.effects(Q.run_designs(strands, [1, 3, 6]), risk).collect()}
    assert runs[3].mean < runs[6].mean and abs(runs[6].mean - 0.6) < 0.02
    made = Q.run_designs(spark.createDataFrame([(1, plain)], "strand_id long, strand string"), [1, 2, 5]).collect()
    assert all(len(r.strand) == len(plain) and max(len(m) for m in __import__("re").findall(r"A+|C+|G+|T+", r.strand)) >= r.probe for r in made)
    shares = Q.gc_designs(strands, [0.0, 0.5, 1.0], longest=100).groupBy("probe").agg(F.avg(S.gc_fraction(F.col("strand"))).alias("gc")).collect()
    assert {r.probe: round(r.gc, 1) for r in shares} == {0.0: 0.0, 0.5: 0.5, 1.0: 1.0}
    assert Q.gc_designs(strands, [0.5]).where(S.max_run_length(F.col("strand")) > 3).count() == 0


def test_guards_count_in_the_pass_and_refuse_after_it(spark):
    ids = spark.range(10).withColumnRenamed("id", "seed")
    fine = SeedGuard(start=100, count=5)
    assert fine.watch(ids).groupBy().sum("seed").first()[0] == 45 and fine.check() == 10
    for heldout, wrong in ((False, "3 of 10"), (True, "7 of 10")):
        guard = SeedGuard(heldout, start=4, count=3)
        guard.watch(ids).write.format("noop").mode("overwrite").save()
        with pytest.raises(ValueError, match=wrong):
            guard.check()
    guard = SeedGuard()
    guard.watch(spark.createDataFrame([(None,), (1,)], "seed long")).count()
    with pytest.raises(ValueError, match="1 of 2"):
        guard.check()


def test_trees_are_lenient_to_missing_and_strict_to_unknown(spark, tmp_path):
    it = {"iteration": 1, "metrics": {"bits_per_base": 1.5, "reads": 4}, "risky_kmers": [["ACG", 0.5], ["TTT", 1]], "notes": "a \"b\""}
    run = {"situation": "x", "recovery_target": 0.9, "n_trials": 3, "iterations": [it, it | {"stage": "tier1", "min_reads_at_target": 2}], "is_mock": False}
    (tmp_path / "a.json").write_text(json.dumps(run) + "\n\n" + json.dumps(run | {"iterations": []}) + "\n")
    one, none = sorted(trees.read_runs(spark, str(tmp_path / "a.json")).collect(), key=lambda r: -len(r.iterations))
    assert none.iterations == [] and one.n_trials == 3 and one.is_mock is False
    first, second = one.iterations
    assert first.stage == "" and first.min_reads_at_target is None and second.stage == "tier1" and second.min_reads_at_target == 2
    assert first.metrics.bits_per_base == 1.5 and [(k.kmer, k.risk) for k in first.risky_kmers] == [("ACG", 0.5), ("TTT", 1.0)] and first.notes == 'a "b"'
    for bad, what in ((run | {"colour": 1}, "unknown fields colour"), (run | {"iterations": [it | {"hue": 2}]}, "unknown fields hue"), ({k: v for k, v in run.items() if k != "n_trials"}, "lacks n_trials"), ([1], "not an object")):
        (tmp_path / "b.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match=what):
            trees.read_runs(spark, str(tmp_path / "b.json")).collect()


def test_position_errors_add_up_to_the_mean_distance(spark):
    rows = [("g", "ACGT", "ACGT"), ("g", "ACGT", "AGT"), ("g", "ACGTA", "ACGTAC"), ("g", "ACGT", None), ("h", "AC", "TTT"), ("h", "", "A")]
    df = spark.createDataFrame(rows, "p string, reference string, decoded string")
    got = {}
    for r in C.position_errors(df, ["p"]).orderBy("p", "pos").collect():
        got.setdefault(r.p, []).append(round(r.rate, 6))
    assert got["g"] == [0, round(1 / 3, 6), 0, 0, round(1 / 3, 6)] and len(got["h"]) == 2 and sum(got["h"]) == 2.0


def test_shared_errors(spark):
    reads = spark.createDataFrame([(1, k, "ACGTACGTAC") for k in range(10)] + [(2, k, "ACGTACGTAC") for k in range(3)], "strand_id int, read_no int, strand string")
    ops = [(1, k, "replace", 4) for k in range(2)] + [(1, 5, "replace", 7), (1, 6, "insert", 10), (1, 7, "insert", 9), (2, 0, "replace", 1), (2, 1, "replace", 1)] + [(1, 9, "delete", i) for i in range(4)]
    got = {r.tag: r for r in E.shared_errors(reads, spark.createDataFrame(ops, "strand_id int, read_no int, tag string, src_pos int")).collect()}
    assert not got  # the tenth read is an outlier, and nine are too few
    more = reads.union(spark.createDataFrame([(1, 10, "ACGTACGTAC")], reads.schema))
    got = {r.tag: r for r in E.shared_errors(more, spark.createDataFrame(ops, "strand_id int, read_no int, tag string, src_pos int")).collect()}
    assert (got["replace"].hot, got["replace"].places, got["replace"].of_errors) == (1, 10, round(2 / 3, 9)) and got["insert"].hot == 1 and "delete" not in got


def test_places_in_groups_and_runs(spark):
    from strandlake.operators.ordering import placed

    rng = np.random.default_rng(5)
    rows = [(None if k == 9 else int(k), int(x), i) for i, (k, x) in enumerate(zip(rng.choice([1, 1, 1, 2, 9], 3000), rng.integers(0, 50, 3000)))]
    df = spark.createDataFrame(rows, "g int, x int, id int").repartition(7)
    got = {r.id: (r.i, r.n, r.total) for r in placed(df, ["g"], ["x", "id"], {"total": F.col("x")}).collect()}
    for g in (1, 2, None):
        group, total = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 0
        for place, r in enumerate(group):
            total += r[1]
            assert got[r[2]] == (place, len(group), total)
    s = spark.createDataFrame([(0, "AACGGG"), (1, ""), (2, "T"), (3, "ACA")], "i int, s string").select("i", S.runs(F.col("s")).alias("r")).orderBy("i").collect()
    assert [[tuple(x) for x in r.r] for r in s] == [[("A", 1, 2), ("C", 3, 1), ("G", 4, 3)], [], [("T", 1, 1)], [("A", 1, 1), ("C", 2, 1), ("A", 3, 1)]]
