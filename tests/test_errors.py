"""Error statistics, marks, streams of passes, ordering and the learned scorer against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions.cutting import count_kmers
from strandlake.operators import consensus as C
from strandlake.operators import errors as E
from strandlake.operators import experiments as X
from strandlake.operators import fountain as L
from strandlake.operators import risk
from strandlake.operators.ordering import ntile, numbered
from strandlake.plans.base import kmer_counts, strands
from strandlake.sources import payloads as S
from strandlake.streaming import ticker


def test_strands_of_odd_texts(spark):
    texts = [None, "", "a", "é" * 14, "x" * 28, "y" * 29, "z" * 100000]
    rows = strands(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")).collect()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        got = sorted((r.chunk, r.strand) for r in rows if r.id == i)
        whole = "".join("ACGT"[b >> s & 3] for b in raw for s in (6, 4, 2, 0))
        assert [c for c, _ in got] == list(range(-(-len(raw) // 28))) and "".join(s for _, s in got) == whole
    assert strands(spark.createDataFrame([], "id long, text string")).count() == 0


def test_kmer_counts(spark):
    rng = random.Random(1)
    rows = [(g, "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 30)))) for g in ("a", "b", None) for _ in range(40)]
    expected = {}
    for g, s in rows:
        for k in (1, 3):
            for i in range(len(s) - k + 1):
                if "N" not in s[i : i + k]:
                    expected[g, k, s[i : i + k]] = expected.get((g, k, s[i : i + k]), 0) + 1
    got = kmer_counts(spark.createDataFrame(rows, "group string, strand string").repartition(3), (1, 3)).collect()
    assert {(r["group"], r.k, r.kmer): r.n for r in got} == expected and callable(count_kmers)


def test_marks_of_scripts(spark):
    rng = random.Random(2)
    pairs = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(pairs, "id long, a string, b string")
    ops = C.edit_operations(df, "a", "b").withColumn("letter", F.substring("a", F.col("src_pos") + 1, F.lit(1)))
    read, fix = {r.id: r.marks for r in E.read_marks(ops, ["id"], 8).collect()}, {r.id: r for r in E.fix_marks(ops, ["id"], 8).collect()}
    for i, a, b in pairs:
        script = C.edit_script(a, b)
        if script:
            marks = sorted({(s, {"replace": "x", "delete": "e", "insert": "m"}[t]) for t, s, _ in script if s < 8})
            assert read[i] == "".join(f"{p}{k}" for p, k in marks)
            was = {}
            for t, s, d in script:
                if d < 8:
                    was.setdefault((d, {"replace": "s", "insert": "i", "delete": "d"}[t]), "-" if t == "insert" else a[s])
            assert (fix[i].marks, fix[i].replaced, fix[i].total) == ("".join(f"{p}{k}" for p, k in sorted(was)), "".join(was[m] for m in sorted(was)), len(script))
    assert df.select(E.trim_marks(F.lit("0x7e12m"), 8)).first()[0] == "0x7e"


def test_error_counts(spark):
    s = [(0, "AACCC"), (1, "ACGTA")]
    ops = [(0, 0, "replace", 1), (0, 0, "insert", 5), (0, 1, "delete", 2), (1, 0, "replace", 0), (1, 1, "replace", 0), (1, 1, "replace", 1)]
    st = spark.createDataFrame(s, "strand_id long, strand string")
    op = spark.createDataFrame(ops, "strand_id long, read_no long, tag string, src_pos int")
    reads = E.without_outliers(spark.createDataFrame([(0, 0, "AACCC"), (0, 1, "AACCC"), (1, 0, "ACGTA"), (1, 1, "ACGTA")], "strand_id long, read_no long, strand string"), op)
    assert sorted((r.strand_id, r.read_no, r.n_edits) for r in reads.collect()) == [(0, 1, 1), (1, 0, 1)]  # two edits of five bases are too many
    got = {(r.scope, r.key, r.tag): (r.events, r.bases) for r in E.error_counts(st, reads, op).collect()}
    assert got["position", 2, "delete"] == (1, 2) and got["position", 0, "replace"] == (1, 2) and got["run", 3, "delete"] == (1, 3) and got["run", 1, "replace"] == (1, 5) and got["run", 2, "insert"] == (0, 2)
    assert got["context", 0 * 256 + 0 * 64 + 16 + 4 + 1, "delete"] == (1, 1) and sum(k[0] == "context" for k in got) == 6


def test_numbers_and_groups(spark):
    rows = [(random.Random(i).randrange(20), i) for i in range(103)]
    df = numbered(spark.createDataFrame(rows, "v int, id int").repartition(7), ["v", "id"])
    got = df.withColumn("g", ntile(F.col("i"), F.lit(103), 10)).collect()
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r.i)] == sorted(rows) and sorted(r.i for r in got) == list(range(103))
    sizes = [sum(r.g == g for r in got) for g in range(1, 11)]
    assert sizes == [11] * 3 + [10] * 7


def test_per_trial_wants_a_trial_for_each_seed(spark):
    seeds = spark.createDataFrame([(1,), (2,)], "seed long")
    t = spark.createDataFrame([("a", 1, 1.0, 0.0), ("a", 2, 0.0, 1.0), ("b", 1, 1.0, 1.0)], "codec string, seed long, accuracy double, recovered double")
    assert X.per_trial(t.where("codec = 'a'"), seeds, ["codec"]).first().accuracy == 0.5
    with pytest.raises(Exception, match="per-trial results for 1 trials, expected 2"):
        X.per_trial(t, seeds, ["codec"]).collect()


def test_peeling_goes_on_to_the_end(spark):
    # a chain: each round frees one more chunk
    edges = [(0, 0)] + [(i, c) for i in range(1, 8) for c in (i - 1, i)] + [(20, 50), (20, 51)]
    got = {r.chunk: r.round for r in L.peel(spark.createDataFrame(edges, "eq long, chunk long")).collect()}
    assert got == {i: i + 1 for i in range(8)}


def test_starred_files(spark, tmp_path):
    text = "ACGT\n*****\nACG\nACGT\n\n\nTTTT\n****\n\n\nGGGG\n***\nGGG\n"
    for i, end in enumerate(("", "\n\n")):
        (tmp_path / f"{i}.txt").write_text(text + end)
        rows = [(r.cluster, r.reference, r.read_no, r.read) for r in S.read_starred_clusters(spark, str(tmp_path / f"{i}.txt")).orderBy("cluster", "read_no").collect()]
        assert rows == [(0, "ACGT", 0, "ACG"), (0, "ACGT", 1, "ACGT"), (1, "TTTT", None, None), (2, "GGGG", 0, "GGG")]
        assert S.read_starred_clusters(spark, str(tmp_path / f"{i}.txt"), complete_only=True).where("cluster = 2").count() == i
    both = S.read_starred_clusters(spark, str(tmp_path / "*.txt"))
    assert sorted(r.cluster for r in both.select("cluster").distinct().collect()) == list(range(6))


def test_passes_over_several_batches(spark, tmp_path):
    rng = random.Random(3)
    events = [(k, i, float(rng.randrange(100))) for k in (1, 2) for i in range(k * 17)]
    for n, part in enumerate((range(0, 9), range(9, 11), range(11, 34))):
        spark.createDataFrame([e for e in events if e[1] in part], "key long, event_id long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    schema = "key long, event_id long, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for name, df, mode in (("p", ticker.passes_stream(stream, 10), "append"), ("t", ticker.running_totals_stream(stream), "append")):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-log")).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect())
    assert got == sorted((k, p, p * 10 + 9, sum(v for x, i, v in events if x == k and i // 10 == p)) for k in (1, 2) for p in range(k * 17 // 10))
    totals = {(r.key, r.event_id): (r.done, r.total) for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert totals == {(k, i): (i + 1, sum(v for x, j, v in events if x == k and j <= i)) for k, i, _ in events}


def test_evenly_spaced_reads_and_ties(spark):
    reads = spark.createDataFrame([(0, i * 3, "A") for i in range(40)] + [(1, i, "C") for i in range(16)], "strand_id long, read_no long, read string")
    got = C.evenly(reads).collect()
    assert sorted(r.i for r in got if r.strand_id == 0) == [round(k * 39 / 15) for k in range(16)] and sum(r.strand_id == 1 for r in got) == 16
    v = C.votes(spark.createDataFrame([(0, 0, "TA"), (0, 1, "CA")], "strand_id long, read_no long, read string"))
    drafts = spark.createDataFrame([(0, "TA")], "strand_id long, draft string")
    assert C.plurality(v).first().consensus == "CA" and C.plurality(v, drafts).first().consensus == "TA"


def test_learned_scorer_ranks_long_runs_higher(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        s = "".join(rng.choice("ACGT") for _ in range(40))
        bad = rng.random() < 0.5
        rows.append((s[:20] + "GGGGGG" + s[20:] if bad else s.replace("GGG", "GCG"), 0.9 if bad else 0.1))
    df = spark.createDataFrame([*rows, ("ACGT", None), ("", float("nan"))], "strand string, risk double")
    scored = risk.score(df, risk.fit(df)).where("risk is not null and not isnan(risk)").collect()
    assert sum((r.risk_score > 0.5) == (r.risk > 0.5) for r in scored) > 280
    assert risk.feature_row("AACG")[:4].tolist() == [0.5, 0.25, 0.25, 0] and risk.feature_row("").sum() == 1
