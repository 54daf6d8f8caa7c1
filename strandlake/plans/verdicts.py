"""Queries on verdicts, sort keys, rounding and trials by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import experiments as E
from strandlake.operators.ordering import placed, range_count
from strandlake.plans.base import query, table

GRID = [2.0, 4.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0, 40.0]
# Settings from suppliers of parts: the reads that the default and the tuned one need, and their bits per base: means to whole hundredths, times ten. A mean
# is taken to seven more places first, so that a half is one in whatever order its lines are summed.
_PAIRED = """p AS (SELECT l_partkey AS id, min(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS d, min(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS t, round(round(avg(l_discount) * 100, 7)) / 10 AS d_bits, round(round(avg(l_tax) * 100, 7)) / 10 AS t_bits,
min(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS m FROM lineitem GROUP BY 1)"""


def _step(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 9 ELSE (SELECT count(*) FROM (SELECT unnest({GRID}) AS g) WHERE g < {c} - 1e-9) END"


def _bits(c: str) -> Column:
    """The mean of c in whole hundredths, times ten. Spark rounds to places in decimals and SQL in doubles, which part at a half of the seventh place; whole numbers they round alike."""
    mean = F.avg(c) * 100
    shifted = mean * 1e7
    return F.round(F.when(F.abs(shifted) < float("inf"), F.round(shifted) / 1e7).otherwise(mean)) / 10


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda n: F.min(F.when(F.col("l_linenumber") == n, F.col("l_quantity")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(q(1).alias("d"), q(2).alias("t"), _bits("l_discount").alias("d_bits"), _bits("l_tax").alias("t_bits"), q(3).alias("m"))


@query("e7_matched_and_redundancy", f"""WITH {_PAIRED}, s AS (SELECT *, {_step("d")} AS ds, {_step("t")} AS ts, coalesce(d <= 20, false) AS old, coalesce(t <= 20, false) AS new FROM p)
SELECT id, ds::INT AS step, CASE WHEN ds - ts >= 1 THEN 'tuned is better' WHEN ds - ts <= -1 THEN 'harmful' ELSE 'no measurable benefit' END AS matched,
CASE WHEN (new AND old AND t_bits > d_bits + 1e-9) OR (new AND NOT old) OR (NOT new AND NOT old AND ds - ts >= 1) THEN 'tuned is better' ELSE 'default is fine' END AS redundancy FROM s""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on tuned settings against default ones by whole steps of the grid, and by a budget of twenty reads."""
    d, t = F.col("d"), F.col("t")
    return paired(spark, sf_dir).select("id", E.grid_step(d, GRID).alias("step"), E.matched_verdict(d, t, GRID).alias("matched"), E.redundancy_verdict(F.lit(20), d, F.col("d_bits"), t, F.col("t_bits"), GRID).alias("redundancy"))


@query("q2_tradeoff", f"""WITH {_PAIRED} SELECT id, concat_ws(', ', CASE WHEN t_bits < d_bits - 1e-9 THEN 'sparser' WHEN t_bits > d_bits + 1e-9 THEN 'denser' END, CASE WHEN m IS NULL OR t IS NULL THEN NULL WHEN m <= t THEN 'settings' ELSE 'rules' END) AS note FROM p""")
def tradeoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).select("id", E.tradeoff(F.col("d_bits"), F.col("t_bits"), F.col("m"), F.col("t")).alias("note"))


@query("q4_sort_keys", """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_mktsegment, c_custkey)::INT AS place FROM customer""")
def sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of customers in a nation, by a list of segments first and then by name."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    return placed(c, ["c_nationkey"], [*E.in_order(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"]), "c_custkey"]).select("c_custkey", (F.col("i") + 1).cast("int").alias("place"))


@query("q11_rounded", """SELECT l_orderkey, l_linenumber, round(l_quantity / 7, 3) AS rate, [round(l_discount / 3, 2), round(l_tax / 3, 2)] AS factors FROM lineitem""")
def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields rounded to places of their own, arrays among them."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 7).alias("rate"), F.array(F.col("l_discount") / 3, F.col("l_tax") / 3).alias("factors"))
    return E.rounded(t, {"rate": 3, "factors": 2})


@query("q19_per_trial", """SELECT l_linenumber, count(*) AS n, round(avg(l_discount), 9) AS accuracy, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), 9) AS recovered FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) AS seed FROM lineitem)
WHERE seed <= (SELECT min(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_linenumber)) GROUP BY 1""")
def trials_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over trials with the seeds that all settings have; a setting with other than one trial for each seed would be an error."""
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")
    rows = placed(lines, ["l_linenumber"], ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]).withColumn("seed", F.col("i") + 1)
    # one deal by seed serves the seeds, the join and the counts; its parts grow in number, not in size
    trials = rows.select("l_linenumber", "seed", F.col("l_discount").alias("accuracy"), (F.col("l_returnflag") == "R").cast("double").alias("recovered")).repartition(range_count(lines), "seed")
    settings = lines.agg(F.count_distinct("l_linenumber").alias("all"))
    seeds = trials.groupBy("seed").agg(F.count("*").alias("n")).crossJoin(F.broadcast(settings)).where(F.col("n") == F.col("all")).select("seed")  # one row
    t = E.per_trial(trials, seeds, ["l_linenumber"])
    return t.select("l_linenumber", "n", F.round("accuracy", 9).alias("accuracy"), F.round("recovered", 9).alias("recovered"))
