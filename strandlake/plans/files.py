"""Queries that write derived data in a file format and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.strands import gc_fraction
from strandlake.operators import channel as X
from strandlake.operators.experiments import rounded
from strandlake.plans import channel as P
from strandlake.plans.base import SQL_BENCH, SQL_GC, benchmark_strands, kmer_counts, query, table
from strandlake.sources import payloads as S
from strandlake.sources import trees
from strandlake.sources.scratch import fresh_path


@query("s1_delimited_clusters", f"""WITH {P.SQL_READS}, {P._mutated(0.02, 0.0, 0.0)}, d AS (SELECT strand_id, strand, row_number() OVER (ORDER BY strand_id) - 1 AS cluster FROM strands)
SELECT cluster, d.strand AS reference, (m.read_no - 1)::INT AS read_no, m.read FROM d LEFT JOIN mutated m USING (strand_id)""")
def delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters written as reference lines and delimited sections, and read back; clusters without reads stay."""
    s = benchmark_strands(spark, sf_dir).select("strand_id", F.col("strand").alias("reference"))
    r = X.mutate(P.reads(spark, sf_dir), 0.02, 0.0, 0.0, P.SEED).select("strand_id", "read_no", "read")
    centers, clusters = fresh_path(spark, "centers"), fresh_path(spark, "clusters")
    S.write_delimited_clusters(s.join(r, "strand_id", "left"), "strand_id", centers, clusters)
    return S.read_delimited_clusters(spark, centers, clusters)


@query("s7_s8_saved_runs", """SELECT o_orderpriority AS situation, year(o_orderdate)::VARCHAR AS run_id, count(*) AS n_trials, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2""")
def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results saved as JSON by run, and loaded again."""
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("situation"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("run_id")).agg(F.count("*").alias("n_trials"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    path = fresh_path(spark, "runs")
    S.save_runs(r, path)
    return S.load_runs(spark, path).select("situation", F.substring("run_id", 2, 4).alias("run_id"), "n_trials", "mean")


@query("s8_run_ids", "SELECT DISTINCT 'y' || year(o_orderdate)::VARCHAR AS run_id FROM orders")
def saved_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of a folder of results, by its files alone."""
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("situation"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("run_id")).agg(F.count("*").alias("n_trials"))
    path = fresh_path(spark, "runs")
    S.save_runs(r, path)
    return S.run_ids(spark, path).select(F.substring_index("run_id", "=", -1).alias("run_id"))


@query("s10_r7_recordings", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events recorded as JSON lines and replayed as a stream."""
    from strandlake.plans.streams import _run
    from strandlake.streaming.ticker import replay

    path = fresh_path(spark, "recording")
    table(spark, sf_dir, "events").select("user_id", "event_id", "value").write.json(path)
    s = replay(spark, path, "user_id long, event_id long, value double", 4)
    return _run(s.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")), "complete")


@query("s4_s12_payload_files", f"WITH {SQL_BENCH} SELECT count(*) AS n, round(avg({SQL_GC}), 9) AS gc FROM strands")
def payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands through a Parquet table and back."""
    path = fresh_path(spark, "strands")
    benchmark_strands(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.round(F.avg(gc_fraction(F.col("strand"))), 9).alias("gc"))


_CLUSTERS = f"""WITH {P.SQL_READS}, {P._mutated(0.02, 0.0, 0.0)}, d AS (SELECT strand_id, strand, row_number() OVER (ORDER BY strand_id) - 1 AS cluster FROM strands)
SELECT cluster, d.strand AS reference, (m.read_no - 1)::INT AS read_no, m.read FROM d LEFT JOIN mutated m USING (strand_id)"""


def _starred(spark: SparkSession, sf_dir: str, cut: bool) -> str:
    s = benchmark_strands(spark, sf_dir).select("strand_id", F.col("strand").alias("reference"))
    r = X.mutate(P.reads(spark, sf_dir), 0.02, 0.0, 0.0, P.SEED).select("strand_id", "read_no", "read")
    path = fresh_path(spark, "starred")
    S.write_starred_clusters(s.join(r, "strand_id", "left"), "strand_id", path, cut)
    return path


@query("s2_starred_clusters", _CLUSTERS)
def starred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters in records with a starred line, the last one without its end, written and read back."""
    return S.read_starred_clusters(spark, _starred(spark, sf_dir, True))


@query("s3_complete_clusters", f"{_CLUSTERS} WHERE d.cluster < (SELECT max(cluster) FROM d)")
def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a last record that may be cut."""
    return S.read_starred_clusters(spark, _starred(spark, sf_dir, True), complete_only=True)


@query("s5_s6_context_table", f"""WITH {SQL_BENCH}, k AS (SELECT unnest(list_transform(range(1, length(strand) - 1), lambda i: substr(strand, i, 3))) AS kmer FROM strands), n AS (SELECT kmer, count(*) AS n FROM k GROUP BY 1),
d AS (SELECT i AS kmer_id, substr('ACGT', i // 16 + 1, 1) || substr('ACGT', i // 4 % 4 + 1, 1) || substr('ACGT', i % 4 + 1, 1) AS kmer FROM range(64) r(i)), m AS (SELECT kmer_id, coalesce(n, 0) * 64.0::DOUBLE / (SELECT count(*) FROM k) AS m FROM d LEFT JOIN n USING (kmer)),
t AS (SELECT *, unnest([0, 1, 2]) AS e FROM m) SELECT ['sub', 'ins', 'del'][e + 1] AS err_type, kmer_id::INT AS kmer_id, round(m / (e + 1), 4) AS mult FROM t""")
def context_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipliers of contexts by how often each is met, written as a context table and read back with its checks."""
    n = kmer_counts(benchmark_strands(spark, sf_dir).select(F.lit(0).alias("group"), "strand"), (3,)).select("kmer", "n")
    i = F.col("id")
    kmer = F.concat(*(F.substring(F.lit("ACGT"), F.floor(i / 4**p).cast("int") % 4 + 1, F.lit(1)) for p in (2, 1, 0)))
    every = spark.range(64).select(i.cast("int").alias("kmer_id"), kmer.alias("kmer")).join(n, "kmer", "left").crossJoin(F.broadcast(n.agg(F.sum("n").alias("all"))))  # one row
    kinds = F.array(*(F.struct(F.lit(c).alias("err_type"), F.lit(d).alias("d")) for c, d in (("sub", 1), ("ins", 2), ("del", 3))))
    t = every.withColumn("e", F.explode(kinds)).select("e.err_type", "kmer_id", (F.coalesce("n", F.lit(0)) * 64.0 / F.col("all") / F.col("e.d")).alias("mult"))
    path = fresh_path(spark, "contexts")
    S.write_context_table(t, path)
    return S.read_context_table(spark, path, 3)


@query("s12_payloads_of_files", """WITH t AS (SELECT c_mktsegment AS segment, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS t FROM customer GROUP BY 1)
SELECT segment, length(t)::BIGINT AS n_bytes, md5(substr(t, 1, 1000)) AS head, 'text' AS kind FROM t""")
def payloads_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written to a file for each segment, and read as payloads cut to a thousand bytes."""
    path = fresh_path(spark, "payloads")
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name")
    c.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").select("c_mktsegment", "c_name").write.partitionBy("c_mktsegment").text(path)
    p = S.read_payloads(spark, path, 1000)
    return p.select(F.regexp_extract("path", "c_mktsegment=([A-Z]+)", 1).alias("segment"), "n_bytes", F.md5("content").alias("head"), "kind")


@query("s4_profiles", """SELECT n_name AS name, round(avg(s_acctbal) / 1e6, 5) AS sub_rate, count(*)::DOUBLE AS coverage_mean, [1.0::DOUBLE, round(max(s_acctbal) / 1000, 3)] AS homopolymer_run_factors, NULL::VARCHAR AS context_table FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each nation, rounded, saved as a JSON file and loaded again."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    p = s.groupBy(F.col("n_name").alias("name")).agg((F.avg("s_acctbal") / 1e6).alias("sub_rate"), F.count("*").cast("double").alias("coverage_mean"), F.array(F.lit(1.0), F.max("s_acctbal") / 1000).alias("homopolymer_run_factors"))
    path = fresh_path(spark, "profiles")
    S.write_profiles(rounded(p, {"sub_rate": 5, "homopolymer_run_factors": 3}), path)
    return S.read_profiles(spark, path).select("name", "sub_rate", "coverage_mean", "homopolymer_run_factors", "context_table")


@query("f37_run_trees", """SELECT o_custkey, count(*) AS iterations, round(arg_max(o_totalprice, o_orderkey), 2) AS last_bits, count(*) FILTER (o_orderkey % 2 = 0) AS staged, round(sum(o_totalprice / 1000 + 0.25), 6) AS risk,
round(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 + 1.5::DOUBLE END), 4) AS reads FROM orders GROUP BY 1""")
def run_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as the nested result of a run, written as JSON lines and read back; fields that came later are missing from some of them."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kmers = F.array(F.array(F.lit("ACG"), (F.col("o_totalprice") / 1000).cast("string")), F.array(F.lit("TTT"), F.lit("0.25")))
    iteration = F.struct(
        key.cast("int").alias("iteration"), F.struct(F.col("o_totalprice").alias("bits_per_base"), F.lit(3.0).alias("reads")).alias("metrics"), kmers.alias("risky_kmers"), F.lit("a \"note\"\n").alias("notes"),
        F.when(key % 2 == 0, F.lit("tier1")).alias("stage"), F.when(key % 3 == 0, key % 7 + 1.5).alias("min_reads_at_target"),
    )
    run = F.struct(F.col("o_custkey").cast("string").alias("situation"), F.lit(0.99).alias("recovery_target"), F.lit(100).alias("n_trials"), F.array_sort(F.collect_list(iteration)).alias("iterations"), F.lit(False).alias("is_mock"))
    path = fresh_path(spark, "runs")
    o.groupBy("o_custkey").agg(F.to_json(run).alias("value")).select("value").write.text(path)
    r = trees.read_runs(spark, path)
    each = r.select(F.col("situation").cast("bigint").alias("o_custkey"), F.explode("iterations").alias("i"))
    return each.groupBy("o_custkey").agg(
        F.count("*").alias("iterations"), F.round(F.max_by("i.metrics.bits_per_base", "i.iteration"), 2).alias("last_bits"), F.count_if(F.col("i.stage") == "tier1").alias("staged"),
        F.round(F.sum(F.aggregate("i.risky_kmers", F.lit(0.0), lambda a, k: a + k.risk)), 6).alias("risk"), F.round(F.sum("i.min_reads_at_target"), 4).alias("reads"),
    )
