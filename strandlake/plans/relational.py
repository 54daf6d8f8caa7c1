"""Queries on joins, set operations, ranking choices and experiment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import strands as S
from strandlake.operators import experiments as E
from strandlake.operators.ordering import numbered, placed
from strandlake.plans.base import SQL_GC, SQL_RUN, SQL_STRANDS, document_strands, kmer_counts, query, table

# Trials from orders: the codec is the customer's segment, coverage the order's priority, recovered the status.
_RATES = """rates AS (SELECT c_mktsegment AS codec, (o_custkey % 12 + 1)::DOUBLE AS coverage, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END)::DOUBLE AS rate, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("codec"), (F.col("o_custkey") % 12 + 1).cast("double").alias("coverage")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"), F.count("*").alias("n"))


@query("j1_j11_strands_and_reads", """SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_reads, n IS NULL AS lost FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def designed_and_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_reads"), F.col("n").isNull().alias("lost"))


@query("j8_e4_settings_grid", """WITH t AS (SELECT n_regionkey, quantile_cont(c_acctbal, 0.5) AS threshold FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 20)
SELECT DISTINCT r_regionkey, redundancy, hp, round(threshold, 4) AS threshold FROM region CROSS JOIN (VALUES (0.3::DOUBLE), (0.6), (1.0)) a(redundancy) CROSS JOIN (VALUES (3), (4), (NULL)) b(hp) JOIN t ON n_regionkey = r_regionkey""")
def settings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of settings, with the threshold of their group; combinations without one are skipped."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = c.groupBy("n_regionkey").agg(F.percentile("c_acctbal", F.lit(0.5)).alias("threshold"), F.count("*").alias("n")).where("n >= 20")
    g = E.grid({"r": table(spark, sf_dir, "region").select("r_regionkey"), "a": spark.createDataFrame([(0.3,), (0.6,), (1.0,)], "redundancy double"), "b": spark.createDataFrame([(3,), (4,), (None,)], "hp int")})
    return g.join(t, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "redundancy", "hp", F.round("threshold", 4).alias("threshold"))


@query("j9_e9_crossover", f"""WITH {_RATES}, b AS (SELECT codec, coverage, rate FROM rates WHERE codec = 'BUILDING') SELECT r.codec, r.coverage, round(r.rate, 9) AS rate, round(r.rate - b.rate, 9) AS gain,
CASE WHEN b.rate IS NULL THEN 0 WHEN r.rate - b.rate > 0.005 THEN 1 WHEN r.rate - b.rate < -0.005 THEN -1 ELSE 0 END AS verdict FROM rates r LEFT JOIN b ON b.coverage = r.coverage""")
def crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each codec on each channel against the default one there."""
    r = rates(spark, sf_dir)
    b = r.where(F.col("codec") == "BUILDING").select("coverage", F.col("rate").alias("base"))
    gain = F.col("rate") - F.col("base")
    return r.join(b, "coverage", "left").select("codec", "coverage", F.round("rate", 9).alias("rate"), F.round(gain, 9).alias("gain"), F.when(gain > 0.005, 1).when(gain < -0.005, -1).otherwise(0).alias("verdict"))


_TARGETS = [0.2, 0.3, 0.34, 0.4]


@query("e2_e9_targets_and_verdicts", f"""WITH {_RATES}, c AS (SELECT codec, target, min(CASE WHEN rate >= target THEN coverage END) AS reads, avg(rate) AS bits FROM rates, (SELECT unnest({_TARGETS}::DOUBLE[]) AS target) GROUP BY 1, 2),
v AS (SELECT c.*, CASE WHEN b.reads IS NULL THEN 1 WHEN c.reads < b.reads - 0.05 THEN 1 WHEN c.reads > b.reads + 0.05 THEN -1 ELSE 0 END AS fewer, CASE WHEN c.bits > b.bits + 0.005 THEN 1 WHEN c.bits < b.bits - 0.005 THEN -1 ELSE 0 END AS denser
FROM c JOIN c b ON b.codec = 'BUILDING' AND b.target = c.target)
SELECT codec, target, reads, round(bits, 9) AS bits, CASE WHEN reads IS NULL THEN -1 WHEN fewer >= 0 AND denser >= 0 AND fewer + denser > 0 THEN 1 WHEN fewer <= 0 AND denser <= 0 AND fewer + denser < 0 THEN -1 ELSE 0 END AS verdict FROM v""")
def targets_and_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least coverage at which each codec meets each of several targets, and how it compares with the default one by reads and mean rate together."""
    r = rates(spark, sf_dir).withColumn("target", F.explode(F.array(*map(F.lit, _TARGETS))))
    c = r.groupBy("codec", "target").agg(F.min(F.when(F.col("rate") >= F.col("target"), F.col("coverage"))).alias("reads"), F.avg("rate").alias("bits"))
    b = c.where(F.col("codec") == "BUILDING").select("target", F.col("reads").alias("base_reads"), F.col("bits").alias("base_bits"))
    verdict = E.crossover_verdict(F.col("reads"), F.col("bits"), F.col("base_reads"), F.col("base_bits"))
    return c.join(b, "target").select("codec", "target", "reads", F.round("bits", 9).alias("bits"), verdict.alias("verdict"))


@query("j10_u4_dense_table", """SELECT n_name, p.rule, coalesce(n::VARCHAR, 'not audited') AS cell FROM nation CROSS JOIN (SELECT DISTINCT o_orderpriority || ' ' || o_orderstatus AS rule FROM orders) p LEFT JOIN
(SELECT c_nationkey, o_orderpriority || ' ' || o_orderstatus AS rule, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) c ON c.c_nationkey = n_nationkey AND c.rule = p.rule""")
def dense_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule by situation with every cell there."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("rule"))
    c = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = c.groupBy(F.col("c_nationkey").alias("n_nationkey"), "rule").agg(F.count("*").cast("string").alias("cell"))
    frame = table(spark, sf_dir, "nation").crossJoin(F.broadcast(o.select("rule").distinct()))  # five priorities of three states
    return frame.join(cells, ["n_nationkey", "rule"], "left").select("n_name", "rule", F.coalesce("cell", F.lit("not audited")).alias("cell"))


@query("j12_u3_set_operations", """SELECT 'only observed' AS part, count(*) AS n FROM (SELECT l_suppkey FROM lineitem EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
UNION ALL SELECT 'both', count(*) FROM (SELECT l_suppkey FROM lineitem INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT 'never seen', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select("l_suppkey")
    design = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    never = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    parts = {"only observed": seen.subtract(design), "both": seen.intersect(design), "never seen": never}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("j13_matched_default", """WITH t AS (SELECT p_size, p_brand, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1, 2), d AS (SELECT p_size, price FROM t WHERE p_brand = 'Brand#11'), o AS (SELECT round(avg(p_retailprice), 4) AS price FROM part)
SELECT t.p_size, t.p_brand, t.price, coalesce(d.price, o.price) AS reference, d.price IS NOT NULL AS matched FROM t LEFT JOIN d USING (p_size) CROSS JOIN o""")
def matched_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuned settings against the default of the same size, or the overall one where there is none."""
    p = table(spark, sf_dir, "part")
    t = p.groupBy("p_size", "p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("price"))
    d = t.where(F.col("p_brand") == "Brand#11").select("p_size", F.col("price").alias("own"))
    o = p.agg(F.round(F.avg("p_retailprice"), 4).alias("overall"))
    return t.join(d, "p_size", "left").crossJoin(F.broadcast(o)).select("p_size", "p_brand", "price", F.coalesce("own", "overall").alias("reference"), F.col("own").isNotNull().alias("matched"))  # o is one row


@query("j14_e11_paired_trials", """WITH a AS (SELECT o_custkey % 1000 AS seed, o_custkey, o_orderstatus = 'F' AS ok FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT o_custkey % 1000 AS seed, o_custkey, o_orderstatus = 'F' AS ok FROM orders WHERE o_orderpriority = '5-LOW'),
x AS (SELECT seed, avg(ok::INT) AS r FROM a GROUP BY 1), y AS (SELECT seed, avg(ok::INT) AS r FROM b GROUP BY 1) SELECT count(*) AS pairs, round(avg(y.r - x.r), 9) AS gain FROM x JOIN y USING (seed)""")
def paired_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("seed", F.col("o_custkey") % 1000).withColumn("ok", (F.col("o_orderstatus") == "F").cast("int"))
    x, y = (o.where(F.col("o_orderpriority") == p).groupBy("seed").agg(F.avg("ok").alias(n)) for p, n in (("1-URGENT", "x"), ("5-LOW", "y")))
    return x.join(y, "seed").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("y") - F.col("x")), 9).alias("gain"))


@query("j16_t9_first_meeting", f"""WITH {_RATES}, r AS (SELECT *, lag(coverage) OVER (PARTITION BY codec ORDER BY coverage) AS before FROM rates), m AS (SELECT codec, min(coverage) AS coverage FROM r WHERE rate >= 0.34 GROUP BY 1)
SELECT c.codec, m.coverage, r.before FROM (SELECT DISTINCT codec FROM rates) c LEFT JOIN m USING (codec) LEFT JOIN r ON r.codec = m.codec AND r.coverage = m.coverage""")
def coverage_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_meeting(rates(spark, sf_dir), ["codec"], 0.34)


@query("w6_interpolated_crossing", f"""WITH {_RATES}, r AS (SELECT codec, coverage, rate, lag(coverage) OVER w AS c0, lag(rate) OVER w AS r0 FROM rates WINDOW w AS (PARTITION BY codec ORDER BY coverage)),
k AS (SELECT *, row_number() OVER (PARTITION BY codec ORDER BY coverage) AS k FROM r WHERE rate >= 0.34) SELECT codec, round(CASE WHEN c0 IS NULL OR r0 >= 0.34 THEN coverage ELSE c0 + (0.34 - r0) * (coverage - c0) / (rate - r0) END, 9) AS needed FROM k WHERE k = 1""")
def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.crossing(rates(spark, sf_dir), ["codec"], 0.34).withColumn("needed", F.round("needed", 9))


_GRID = (2, 4, 6, 8, 10, 12)
_STEP = "CASE WHEN {0} IS NULL THEN 6 ELSE ceil(({0} - 1e-9) / 2)::INT - 1 END"


@query("e7_q1_rule_audit", f"""WITH {_RATES}, m AS (SELECT codec, min(CASE WHEN rate >= 0.34 AND coverage % 2 = 0 THEN coverage END) AS off_reads, min(CASE WHEN rate >= 0.34 AND coverage % 2 = 1 THEN coverage + 0.5 END) AS on_reads FROM rates GROUP BY 1),
s AS (SELECT *, {_STEP.format("off_reads")} - {_STEP.format("on_reads")} AS steps FROM m)
SELECT codec, on_reads, off_reads, CASE WHEN steps >= 1 THEN 'pays off' WHEN steps <= -1 THEN 'harmful' ELSE 'no measurable benefit' END AS verdict,
coalesce(abs(on_reads - off_reads) BETWEEN 0.05 AND 1.0, false) AS one_step FROM s""")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each codec with its rule (reads refined to half steps) and without, by whole steps of the grid."""
    met = F.when(F.col("rate") >= 0.34, F.col("coverage"))
    m = rates(spark, sf_dir).groupBy("codec").agg(F.min(F.when(F.col("coverage") % 2 == 1, met + 0.5)).alias("on_reads"), F.min(F.when(F.col("coverage") % 2 == 0, met)).alias("off_reads"))
    on, off = F.col("on_reads"), F.col("off_reads")
    return m.select("codec", on, off, E.rule_verdict(on, off, list(_GRID)).alias("verdict"), E.single_step(on, off).alias("one_step"))


@query("e13_recovery_curve_pivot", f"""WITH {_RATES} SELECT codec, {", ".join(f"round(max(CASE WHEN coverage = {c} THEN rate END), 9) AS c{c}" for c in (1, 4, 8, 12))} FROM rates GROUP BY codec""")
def recovery_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rates(spark, sf_dir).groupBy("codec").pivot("coverage", [1.0, 4.0, 8.0, 12.0]).agg(F.round(F.max("rate"), 9))
    return p.select("codec", *(F.col(f"`{c}.0`").alias(f"c{c}") for c in (1, 4, 8, 12)))


@query("t14_pareto_front", """WITH p AS (SELECT p_brand, p_partkey, p_size, p_retailprice FROM part) SELECT p_partkey, NOT EXISTS (SELECT 1 FROM p b WHERE b.p_brand = a.p_brand AND b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice)) AS front FROM p a""")
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand that no other beats in size and price together."""
    return E.pareto_front(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice").select("p_partkey", "front")


@query("t1_t2_candidates_per_slot", f"""WITH {SQL_STRANDS}, c AS (SELECT doc_id, chunk, {SQL_GC} AS gc, {SQL_RUN} AS run FROM strands), ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS k FROM c WHERE run <= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(gc - 0.5), chunk) AS best FROM ok WHERE k <= 5) SELECT doc_id, chunk, round(gc, 9) AS gc FROM b WHERE best = 1""")
def least_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first five strands of each text that pass the run rule the one of least risk, the earliest on a tie."""
    s = F.col("strand")
    ok = document_strands(spark, sf_dir, "doc_id").where(~S.has_run(s, 3)).select("doc_id", "chunk", S.gc_fraction(s).alias("gc"))
    k = ok.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk"))).where("k <= 5")
    best = k.groupBy("doc_id").agg(F.min(F.struct(F.abs(F.col("gc") - 0.5).alias("risk"), "chunk", "gc")).alias("b"))
    return best.select("doc_id", "b.chunk", F.round("b.gc", 9).alias("gc"))


@query("t6_t12_top_kmers", f"""WITH {SQL_STRANDS}, k AS (SELECT unnest(list_transform(range(1, length(strand) - 3), lambda i: substr(strand, i, 5))) AS kmer FROM strands) SELECT kmer, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, kmer LIMIT 20""")
def top_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent 5-mers."""
    n = kmer_counts(document_strands(spark, sf_dir).withColumn("group", F.lit(0)), (5,))
    return n.select("kmer", "n").orderBy(F.desc("n"), "kmer").limit(20)


@query("t7_p4_candidate_examples", """WITH m AS (SELECT median(p_retailprice) AS m FROM part), c AS (SELECT p_partkey, p_size, p_retailprice, p_size <= 25 AS rules, p_retailprice <= m AS model FROM part, m),
o AS (SELECT *, abs((row_number() OVER (ORDER BY p_size, p_partkey) - 1)::DOUBLE / (count(*) OVER () - 1) - (row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1)::DOUBLE / (count(*) OVER () - 1)) AS spread FROM c)
SELECT p_partkey, rules <> model AS disagree, round(spread, 9) AS spread FROM o ORDER BY disagree DESC, round(spread, 9) DESC, p_partkey LIMIT 8""")
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates on which rules and model disagree most."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    m = p.agg(F.median("p_retailprice").alias("m"), (F.count("*") - 1).alias("last"))
    place = [F.col(c) / F.col("last") for c in ("by_size", "by_price")]
    p = numbered(numbered(p, ["p_size", "p_partkey"], "by_size"), ["p_retailprice", "p_partkey"], "by_price")
    o = p.crossJoin(F.broadcast(m)).select("p_partkey", ((F.col("p_size") <= 25) != (F.col("p_retailprice") <= F.col("m"))).alias("disagree"), F.round(F.abs(place[0] - place[1]), 9).alias("spread"))  # m is one row
    return o.orderBy(F.desc("disagree"), F.desc("spread"), "p_partkey").limit(8)


@query("t8_select_final", """WITH f AS (SELECT s_nationkey, s_suppkey AS i, s_acctbal > 5000 AS target_met, round(s_acctbal / 100) AS bpb, s_suppkey % 7 AS strength FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY target_met DESC, bpb DESC, strength DESC, i) AS k FROM f)
SELECT s_nationkey, i, target_met, bpb AS bits_per_base, strength FROM k WHERE k = 1""")
def final_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    f = s.select("s_nationkey", F.col("s_suppkey").alias("i"), (F.col("s_acctbal") > 5000).alias("target_met"), F.round(F.col("s_acctbal") / 100).alias("bits_per_base"), (F.col("s_suppkey") % 7).alias("strength"))
    return E.select_best(f, ["s_nationkey"])


@query("t11_densest_levels", """WITH r AS (SELECT p_partkey, p_size, dense_rank() OVER (ORDER BY p_size DESC) AS level, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_partkey, p_size, level::INT AS level FROM r WHERE level <= 10 AND k <= 3""")
def densest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best settings of each of the ten densest levels."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    level = p.select("p_size").distinct().orderBy(F.desc("p_size")).limit(10).withColumn("level", F.dense_rank().over(Window.orderBy(F.desc("p_size"))))
    k = F.row_number().over(Window.partitionBy("p_size").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return p.join(F.broadcast(level), "p_size").withColumn("k", k).where("k <= 3").select("p_partkey", "p_size", "level")  # ten rows


@query("q3_crowded_points", """WITH s AS (SELECT n_regionkey, n_nationkey, count(*) AS x, sum(c_acctbal) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT n_regionkey, max(x) - min(x) AS xr, max(y) - min(y) AS yr FROM s GROUP BY 1)
SELECT r.n_regionkey, EXISTS (SELECT 1 FROM s a JOIN s b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE a.n_regionkey = r.n_regionkey AND abs(a.x - b.x) <= 0.15 * xr AND abs(a.y - b.y) <= 0.15 * yr) AS crowded FROM r""")
def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two points of a chart lie within 15% of both spans (a chart has a few points)."""
    s = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count("*").alias("x"), F.sum("c_acctbal").alias("y"))
    g = s.groupBy("n_regionkey").agg(F.collect_list(F.struct("x", "y", "n_nationkey")).alias("p"), (F.max("x") - F.min("x")).alias("xr"), (F.max("y") - F.min("y")).alias("yr"))
    near = F.exists("p", lambda a: F.exists("p", lambda b: (a.n_nationkey < b.n_nationkey) & (F.abs(a.x - b.x) <= 0.15 * F.col("xr")) & (F.abs(a.y - b.y) <= 0.15 * F.col("yr"))))
    return g.select("n_regionkey", near.alias("crowded"))


@query("f31_e10_changes", """WITH y AS (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS total FROM orders GROUP BY 1), c AS (SELECT y, total, lag(total) OVER (ORDER BY y) AS before FROM y)
SELECT y::INT AS y, 'total' AS measure, round(total, 2) AS value FROM c UNION ALL SELECT y, 'change', round(total / nullif(before, 0) - 1, 9) FROM c""")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals and their relative changes, one row for each measure."""
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("t"))
    c = y.select("y", F.round("t", 2).alias("total"), F.round(F.col("t") / F.nullif(F.lag("t").over(Window.orderBy("y")), F.lit(0.0)) - 1, 9).alias("change"))
    return c.unpivot("y", ["total", "change"], "measure", "value")


@query("q17_learning_rate", """SELECT o_orderkey, round(CASE WHEN k < 100 THEN (k + 1) / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (k - 100) / greatest(1, n - 100))) END, 9) AS rate FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""")
def learning_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = placed(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"]).withColumnRenamed("i", "k")
    cosine = 0.1 + 0.9 * 0.5 * (1 + F.cos(F.pi() * (F.col("k") - 100) / F.greatest(F.lit(1), F.col("n") - 100)))
    return s.select("o_orderkey", F.round(F.when(F.col("k") < 100, (F.col("k") + 1) / 100.0).otherwise(cosine), 9).alias("rate"))
