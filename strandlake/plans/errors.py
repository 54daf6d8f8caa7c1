"""Queries on statistics of errors, and on marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import channel as X
from strandlake.operators import errors as E
from strandlake.plans import channel as P
from strandlake.plans.base import benchmark_strands, query, table

_KMER = " + ".join(f"(strpos('ACGT', substr(strand, pos + {j - 1}, 1)) - 1) * {4 ** (4 - j)}" for j in range(5))
_BASES = f"""{P._SUBSTITUTED}, b AS (SELECT strand_id, unnest(range(length(strand))) AS pos, strand FROM strands), i AS (SELECT *, substr(strand, pos + 1, 1) AS base FROM b),
j AS (SELECT *, sum(CASE WHEN base IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY strand_id ORDER BY pos) AS island FROM (SELECT *, lag(base) OVER (PARTITION BY strand_id ORDER BY pos) AS before FROM i)),
bases AS (SELECT strand_id, pos, base, least(7, count(*) OVER (PARTITION BY strand_id, island)) AS run, CASE WHEN pos >= 2 AND pos < length(strand) - 2 THEN {_KMER} ELSE -1 END AS kmer FROM j),
wrong AS (SELECT strand_id, read_no, pos FROM mutated JOIN bases USING (strand_id) WHERE substr(read, pos + 1, 1) <> base),
used AS (SELECT m.strand_id, m.read_no, length(any_value(s.strand)) AS len, count(w.pos) AS n FROM mutated m JOIN strands s USING (strand_id) LEFT JOIN wrong w ON w.strand_id = m.strand_id AND w.read_no = m.read_no GROUP BY 1, 2 HAVING count(w.pos) <= floor(length(any_value(s.strand)) * 0.3))"""


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Strands, reads and the edits of reads whose letters alone are wrong."""
    strands = benchmark_strands(spark, sf_dir).select("strand_id", "strand")
    reads = X.mutate(P.reads(spark, sf_dir), 0.08, 0.0, 0.0, P.SEED)
    letters = F.arrays_zip(F.split("strand", "").alias("a"), F.split("read", "").alias("b"))
    ops = reads.select("strand_id", "read_no", F.posexplode(letters).alias("src_pos", "x")).where("x.a <> x.b").select("strand_id", "read_no", F.lit("replace").alias("tag"), "src_pos")
    return strands, E.without_outliers(reads.select("strand_id", "read_no", "strand"), ops), ops


@query("a10_error_counts", f"""WITH {_BASES}, n AS (SELECT strand_id, count(*) AS n FROM used GROUP BY 1), k AS (SELECT *, unnest([0, 1, 2]) AS z FROM bases),
keyed AS (SELECT strand_id, pos, ['position', 'run', 'context'][z + 1] AS scope, [pos, run, kmer][z + 1] AS key FROM k), d AS (SELECT scope, key, sum(n) AS bases FROM keyed JOIN n USING (strand_id) WHERE key >= 0 GROUP BY 1, 2),
e AS (SELECT scope, key, count(*) AS events FROM wrong JOIN used USING (strand_id, read_no) JOIN keyed USING (strand_id, pos) WHERE key >= 0 GROUP BY 1, 2)
SELECT scope, key, tag, CASE WHEN tag = 'replace' THEN coalesce(events, 0) ELSE 0 END AS events, bases::BIGINT AS bases FROM d LEFT JOIN e USING (scope, key), (SELECT unnest(['replace', 'insert', 'delete']) AS tag)""")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by position, run length and context, with the bases that were read there."""
    return E.error_counts(*_read(spark, sf_dir))


@query("a10_read_errors", f"""WITH {_BASES}, r AS (SELECT n::DOUBLE / len AS rate FROM used) SELECT count(*) AS n_reads, round(avg(rate), 9) AS mean, round(stddev_pop(rate), 9) AS sd, {", ".join(f"round(quantile_cont(rate, {p / 100}), 9) AS p{p:02d}" for p in (5, 25, 50, 75, 95))} FROM r""")
def read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of errors per base over reads."""
    _, reads, _ = _read(spark, sf_dir)
    t = reads.agg(*E.read_errors(reads))
    return t.select("n_reads", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), *(F.round(F.col("percentiles")[i], 9).alias(f"p{p:02d}") for i, p in enumerate((5, 25, 50, 75, 95))))


# Edits from lines of orders: the kind by the flag, places by quantity and number of the line.
_OPS = """ops AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'replace' WHEN 'N' THEN 'delete' ELSE 'insert' END AS tag, l_quantity::INT % 9 AS src_pos, l_linenumber::INT % 4 AS dest_pos, substr('ACGT', l_linenumber::INT % 4 + 1, 1) AS letter FROM lineitem)"""


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linenumber").cast("int") % 4
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(flag == "A", "replace").when(flag == "N", "delete").otherwise("insert").alias("tag"), (F.col("l_quantity").cast("int") % 9).alias("src_pos"), line.alias("dest_pos"), F.substring(F.lit("ACGT"), line + 1, F.lit(1)).alias("letter"))


@query("f16_read_marks", f"""WITH {_OPS}, m AS (SELECT DISTINCT l_orderkey, src_pos AS pos, CASE tag WHEN 'replace' THEN 'x' WHEN 'delete' THEN 'e' ELSE 'm' END AS kind FROM ops)
SELECT l_orderkey, coalesce(string_agg(CASE WHEN pos < 6 THEN pos || kind END, '' ORDER BY pos, kind), '') AS marks, coalesce(string_agg(CASE WHEN pos < 3 THEN pos || kind END, '' ORDER BY pos, kind), '') AS trimmed FROM m GROUP BY 1""")
def read_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of reads within a window of six, and trimmed to three."""
    return E.read_marks(_ops(spark, sf_dir), ["l_orderkey"], 6).withColumn("trimmed", E.trim_marks(F.col("marks"), 3))


@query("f16_fix_marks", f"""WITH {_OPS}, m AS (SELECT l_orderkey, dest_pos AS pos, CASE tag WHEN 'replace' THEN 's' WHEN 'insert' THEN 'i' ELSE 'd' END AS kind, arg_min(CASE WHEN tag = 'insert' THEN '-' ELSE letter END, src_pos) AS was, count(*) AS n FROM ops GROUP BY 1, 2, 3)
SELECT l_orderkey, coalesce(string_agg(CASE WHEN pos < 3 THEN pos || kind END, '' ORDER BY pos, kind), '') AS marks, coalesce(string_agg(CASE WHEN pos < 3 THEN was END, '' ORDER BY pos, kind), '') AS replaced, sum(n)::BIGINT AS total FROM m GROUP BY 1""")
def fix_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of what a correction changed within a window of three, the letters before it, and all its edits."""
    return E.fix_marks(_ops(spark, sf_dir), ["l_orderkey"], 3)
