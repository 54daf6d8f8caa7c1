"""Queries on predicates, failure labels, pooling, state scans and derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import strands as S
from strandlake.operators import channel as X
from strandlake.operators import consensus as C
from strandlake.operators.guards import SeedGuard
from strandlake.operators.ordering import ntile, placed
from strandlake.plans import channel as P
from strandlake.plans.base import SQL_BENCH, SQL_GC, SQL_RUN, SQL_STRANDS, benchmark_strands, document_strands, query, sql_uniform, table
from strandlake.sources.scratch import written

_BAD = f"CASE WHEN length(strand) = 0 OR {SQL_RUN} > 3 OR {SQL_GC} NOT BETWEEN 0.4 AND 0.6 THEN 1.0 ELSE 0.0 END"


@query("p2_rule_scorer", f"WITH {SQL_STRANDS} SELECT source, round(avg({_BAD})::DOUBLE, 9) AS violations, count(*) AS n FROM strands GROUP BY 1")
def rule_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of strands that break a rule."""
    bad = F.when(S.passes_rules(F.col("strand")) & (F.length("strand") > 0), 0.0).otherwise(1.0)
    return document_strands(spark, sf_dir, "source").groupBy("source").agg(F.round(F.avg(bad), 9).alias("violations"), F.count("*").alias("n"))


@query("p3_p11_finite_scores", """WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'nan'::DOUBLE WHEN c_acctbal > 9000 THEN NULL ELSE c_acctbal / 5000 END AS score FROM customer)
SELECT c_custkey, coalesce(CASE WHEN isnan(score) THEN NULL ELSE score END, 'inf'::DOUBLE) <= 1 AS taken, least(1, greatest(0, score))::DOUBLE AS clipped FROM s WHERE score IS NULL OR NOT isnan(score)""")
def finite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates under a threshold; a score that is missing counts as infinite, one that is no number is dropped, labels are clipped."""
    b = F.col("c_acctbal")
    score = F.when(b < 0, float("nan")).when(b > 9000, None).otherwise(b / 5000)
    s = table(spark, sf_dir, "customer").select("c_custkey", score.alias("score")).where("score is null or not isnan(score)")
    return s.select("c_custkey", (F.coalesce("score", F.lit(float("inf"))) <= 1).alias("taken"), F.when(F.col("score").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score"))).alias("clipped")).withColumn("clipped", F.coalesce("clipped", F.lit(0.0)))


@query("p6_p7_splits", """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS held_out, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS train, count(*) FILTER (WHERE o_orderkey BETWEEN 900000 AND 900999) AS reserved FROM orders GROUP BY 1""")
def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.sources.payloads import held_out

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(held_out(k)).alias("held_out"), F.count_if(~held_out(k)).alias("train"), F.count_if(k.between(900000, 900999)).alias("reserved"))


@query("p9_modal_length", f"""WITH {SQL_STRANDS}, n AS (SELECT lang, length(strand) AS len, count(*) AS n FROM strands GROUP BY 1, 2), m AS (SELECT lang, len, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, len) AS k FROM n) SELECT lang, len::INT AS len, n FROM m WHERE k = 1""")
def modal_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent length, the smallest on a tie."""
    n = document_strands(spark, sf_dir, "lang").groupBy("lang", F.length("strand").alias("len")).agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.max(F.struct("n", (-F.col("len")).alias("neg"))).alias("m")).select("lang", (-F.col("m.neg")).alias("len"), "m.n")


@query("p10_enough_reads", """SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 10""")
def enough_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 10")


@query("p12_a39_hotspots", f"""WITH {P.SQL_READS}, {P._mutated(0.08, 0.0, 0.0)}, e AS (SELECT m.strand_id, i.pos, substr(m.read, i.pos, 1) <> substr(s.strand, i.pos, 1) AS wrong FROM mutated m JOIN strands s USING (strand_id), LATERAL (SELECT unnest(range(1, length(s.strand) + 1)) AS pos) i),
p AS (SELECT strand_id, pos, count(*) AS n, count(*) FILTER (WHERE wrong) AS bad FROM e GROUP BY 1, 2) SELECT strand_id, count(*) FILTER (WHERE n >= 10 AND bad >= 0.2 * n) AS hotspots, sum(bad)::BIGINT AS errors FROM p GROUP BY 1""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at which a fifth of at least ten reads err."""
    v = C.votes(P.substituted(spark, sf_dir))
    s = benchmark_strands(spark, sf_dir).select("strand_id", "strand")
    wrong = F.when(F.col("symbol") != F.substring("strand", F.col("pos"), F.lit(1)), F.col("n")).otherwise(0)
    p = v.join(s, "strand_id").groupBy("strand_id", "pos").agg(F.sum("n").alias("n"), F.sum(wrong).alias("bad"))
    return p.groupBy("strand_id").agg(F.count_if((F.col("n") >= 10) & (F.col("bad") >= 0.2 * F.col("n"))).alias("hotspots"), F.sum("bad").alias("errors"))


@query("a3_a5_weighted_pooling", """WITH t AS (SELECT o_custkey, c_mktsegment AS codec, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT codec, round((sum(rate * n) / sum(n))::DOUBLE, 9) AS pooled, round(avg(rate)::DOUBLE, 9) AS mean_of_trials, count(*) AS trials FROM t GROUP BY 1""")
def weighted_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = o.groupBy("o_custkey", F.col("c_mktsegment").alias("codec")).agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"))
    return t.groupBy("codec").agg(F.round(F.sum(F.col("rate") * F.col("n")) / F.sum("n"), 9).alias("pooled"), F.round(F.avg("rate"), 9).alias("mean_of_trials"), F.count("*").alias("trials"))


@query("a6_a7_a21_failure_rates", f"""WITH {P.SQL_READS}, {P._mutated(0.08, 0.0, 0.0)}, v AS (SELECT c.strand_id, c.n_reads, avg(CASE WHEN m.read <> c.strand THEN 1.0 WHEN m.read IS NOT NULL THEN 0 END)::DOUBLE AS rate FROM counted c LEFT JOIN mutated m USING (strand_id) GROUP BY 1, 2)
SELECT n_reads::INT AS n_reads, count(*) AS strands, round(coalesce(avg(rate), 'nan'::DOUBLE), 9) AS failure_rate FROM v GROUP BY 1""")
def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing reads by number of reads; strands without reads have no rate."""
    r = P.substituted(spark, sf_dir).groupBy("strand_id").agg(F.count("*").cast("int").alias("n_reads"), F.avg((F.col("read") != F.col("strand")).cast("double")).alias("rate"))
    v = benchmark_strands(spark, sf_dir).select("strand_id").join(r, "strand_id", "left")
    return v.groupBy(F.coalesce("n_reads", F.lit(0)).alias("n_reads")).agg(F.count("*").alias("strands"), F.round(F.coalesce(F.avg("rate"), F.lit(float("nan"))), 9).alias("failure_rate"))


@query("a30_a34_blocks", """WITH b AS (SELECT o_orderpriority, (o_custkey % 20) AS block, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT o_orderpriority, round(min(v), 4) AS low, round(median(v), 4) AS mid, round(max(v), 4) AS high, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd FROM b GROUP BY 1""")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 20).alias("block")).agg(F.avg("o_totalprice").alias("v"))
    aggs = {"low": F.min("v"), "mid": F.median("v"), "high": F.max("v"), "mean": F.avg("v"), "sd": F.stddev_pop("v")}
    return b.groupBy("o_orderpriority").agg(*(F.round(e, 4).alias(n) for n, e in aggs.items()))


@query("a31_status_counts", """WITH s AS (SELECT c_mktsegment, CASE WHEN o_orderkey IS NULL THEN 'lost' WHEN o_orderstatus = 'F' THEN 'correct' WHEN o_totalprice < 100000 THEN 'slipped' ELSE 'caught' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
SELECT c_mktsegment, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'caught') AS caught, count(*) FILTER (WHERE status = 'lost') AS lost, count(*) FILTER (WHERE status = 'slipped') AS slipped FROM s GROUP BY 1""")
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    status = F.when(F.col("o_orderkey").isNull(), "lost").when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_totalprice") < 100000, "slipped").otherwise("caught")
    return o.groupBy("c_mktsegment").agg(*(F.count_if(status == s).alias(s) for s in ("correct", "caught", "lost", "slipped")))


@query("a36_accuracy_by_budget", f"""WITH {P.SQL_READS}, {P._mutated(0.08, 0.0, 0.0)}, few AS (SELECT b.b AS budget, m.* FROM mutated m, (VALUES (2), (4), (8)) b(b) WHERE m.read_no <= b.b),
v AS (SELECT budget, strand_id, pos, substr(read, pos, 1) AS symbol, count(*) AS n FROM (SELECT *, unnest(range(1, length(read) + 1)) AS pos FROM few) GROUP BY 1, 2, 3, 4), k AS (SELECT *, row_number() OVER (PARTITION BY budget, strand_id, pos ORDER BY n DESC, symbol) AS k FROM v),
d AS (SELECT budget, strand_id, string_agg(symbol, '' ORDER BY pos) AS decoded FROM k WHERE k = 1 GROUP BY 1, 2) SELECT budget::INT AS budget, count(*) AS n, round(avg(CASE WHEN decoded = strand THEN 1.0 ELSE 0 END)::DOUBLE, 9) AS accuracy FROM d JOIN strands USING (strand_id) GROUP BY 1""")
def accuracy_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact strands with two, four and eight reads."""
    few = P.substituted(spark, sf_dir).withColumn("budget", F.explode(F.filter(F.array(*map(F.lit, (2, 4, 8))), lambda b: F.col("read_no") <= b)))
    keyed = few.select(F.struct("budget", "strand_id").alias("strand_id"), "read_no", "read")
    d = C.plurality(C.votes(keyed)).select("strand_id.budget", F.col("strand_id.strand_id").alias("id"), "consensus")
    s = benchmark_strands(spark, sf_dir).select(F.col("strand_id").alias("id"), "strand")
    return d.join(s, "id").groupBy("budget").agg(F.count("*").alias("n"), F.round(F.avg((F.col("consensus") == F.col("strand")).cast("double")), 9).alias("accuracy"))


@query("a37_curve_distance", """WITH q AS (SELECT l_linenumber, avg(l_extendedprice) / 1000 AS a, avg(l_quantity) AS b FROM lineitem GROUP BY 1) SELECT round(corr(ln(a), ln(b)), 6) AS log_correlation, round(sum(pow(a - b, 2)), 6) AS squared FROM q""")
def curve_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg((F.avg("l_extendedprice") / 1000).alias("a"), F.avg("l_quantity").alias("b"))
    return q.agg(F.round(F.corr(F.log("a"), F.log("b")), 6).alias("log_correlation"), F.round(F.sum(F.pow(F.col("a") - F.col("b"), 2)), 6).alias("squared"))


@query("a38_position_fifths", f"""WITH {SQL_BENCH}, p AS (SELECT strand_id, unnest(range(1, length(strand) + 1)) AS pos, strand FROM strands), f AS (SELECT pos, substr(strand, pos, 1) = 'A' AS a, ntile(5) OVER (PARTITION BY strand_id ORDER BY pos) AS fifth FROM p)
SELECT 'fifth' AS kind, fifth::INT AS bucket, count(*) FILTER (WHERE a) AS n FROM f GROUP BY 2 UNION ALL SELECT 'run', least(7, {SQL_RUN})::INT, count(*) FROM strands GROUP BY 2""")
def position_fifths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of labelled rows: a letter by fifth of the strand, and strands by longest run."""
    b = benchmark_strands(spark, sf_dir)
    p = b.select("strand_id", F.length("strand").cast("long").alias("n"), F.posexplode(F.split("strand", "")).alias("pos", "base")).withColumn("bucket", ntile(F.col("pos"), F.col("n"), 5))
    fifths = p.groupBy(F.lit("fifth").alias("kind"), "bucket").agg(F.count_if(F.col("base") == "A").alias("n"))
    runs = b.groupBy(F.lit("run").alias("kind"), F.least(F.lit(7), S.max_run_length(F.col("strand"))).alias("bucket")).agg(F.count("*").alias("n"))
    return fifths.unionByName(runs)


@query("j15_contrasts", """WITH v AS (SELECT c_mktsegment, c_nationkey % 5 AS rule, avg(c_acctbal) > 4500 AS verdict FROM customer GROUP BY 1, 2) SELECT rule::INT AS rule, count(DISTINCT verdict) > 1 AS contrast FROM v GROUP BY 1""")
def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on which situations disagree."""
    v = table(spark, sf_dir, "customer").groupBy("c_mktsegment", (F.col("c_nationkey") % 5).alias("rule")).agg((F.avg("c_acctbal") > 4500).alias("verdict"))
    return v.groupBy("rule").agg((F.count_distinct("verdict") > 1).alias("contrast"))


@query("w9_damaged_segments", f"""WITH {SQL_BENCH}, p AS (SELECT strand_id, unnest(range(1, length(strand) + 1)) AS pos FROM strands), s AS (SELECT strand_id, pos, CASE WHEN {sql_uniform("strand_id", "pos", "'seg'", "7")} < 0.02 THEN pos + 1 + floor({sql_uniform("strand_id", "pos", "'len'", "7")} * 8)::BIGINT END AS until FROM p),
m AS (SELECT strand_id, pos, max(until) OVER (PARTITION BY strand_id ORDER BY pos ROWS UNBOUNDED PRECEDING) > pos AS damaged FROM s) SELECT strand_id, count(*) FILTER (WHERE damaged) AS damaged FROM m GROUP BY 1""")
def damaged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions inside damaged segments: a running maximum of where segments end."""
    p = benchmark_strands(spark, sf_dir).select("strand_id", F.explode(F.sequence(F.lit(1), F.length("strand"))).alias("pos"))
    u = [S.uniform(F.col("strand_id"), F.col("pos"), k, 7) for k in ("seg", "len")]
    s = p.withColumn("until", F.when(u[0] < 0.02, F.col("pos") + 1 + F.floor(u[1] * 8)))
    w = Window.partitionBy("strand_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("damaged", F.max("until").over(w) > F.col("pos")).groupBy("strand_id").agg(F.count_if("damaged").alias("damaged"))


@query("w10_w11_sequential_scans", """WITH RECURSIVE n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT user_id, k, value AS ema, CASE WHEN value > 50 THEN 1 ELSE 0 END AS state, 0 AS flips FROM n WHERE k = 1 UNION ALL
SELECT n.user_id, n.k, 0.98 * r.ema + 0.02 * n.value, CASE WHEN n.value > 75 THEN 1 WHEN n.value < 25 THEN 0 ELSE r.state END, r.flips + CASE WHEN (n.value > 75 AND r.state = 0) OR (n.value < 25 AND r.state = 1) THEN 1 ELSE 0 END FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS last FROM r) SELECT user_id, round(ema, 6) AS ema, flips::INT AS flips FROM z WHERE last = 1""")
def sequential_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smoothed value, and the changes of a two-state burst, along each user's events."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w.orderBy("event_id")).alias("k"), F.count("*").over(w).alias("n"))
    v, first = F.col("value"), F.col("k") == 1
    # the smoothed value is a weighted sum; the state changes where a value beyond the bounds differs from what the last such value said
    weighted = F.when(first, v).otherwise(0.02 * v) * F.pow(F.lit(0.98), F.col("n") - F.col("k"))
    says = F.when(first, (v > 50).cast("int")).when(v > 75, 1).when(v < 25, 0)
    e = e.withColumn("weighted", weighted).withColumn("says", says)
    said = F.last("says", ignorenulls=True).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("flip", (F.col("says") != said).cast("int"))
    return e.groupBy("user_id").agg(F.round(F.sum("weighted"), 6).alias("ema"), F.coalesce(F.sum("flip"), F.lit(0)).cast("int").alias("flips"))


@query("w12_forward_path", """SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS before, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS gain FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def forward_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("gain"))


@query("t4_u5_distinct_drafts", f"""WITH {P.SQL_READS}, {P._mutated(0.01, 0.0, 0.0)}, d AS (SELECT strand_id, read, count(*) AS weight, min(read_no) AS first_no FROM mutated GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY strand_id ORDER BY weight DESC, first_no) AS k FROM d)
SELECT strand_id, read, weight FROM k WHERE k <= 3""")
def distinct_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct starting reads of each strand, those that coincide merged with their weight."""
    d = X.mutate(P.reads(spark, sf_dir), 0.01, 0.0, 0.0, P.SEED).groupBy("strand_id", "read").agg(F.count("*").alias("weight"), F.min("read_no").alias("first_no"))
    w = Window.partitionBy("strand_id").orderBy(F.desc("weight"), "first_no")
    return d.withColumn("k", F.row_number().over(w)).where("k <= 3").select("strand_id", "read", "weight")


@query("t10_refined_targets", """WITH g AS (SELECT DISTINCT o_orderpriority, ceil(o_totalprice / 5000) / 2.0::DOUBLE AS c FROM orders), l AS (SELECT *, lag(c) OVER (PARTITION BY o_orderpriority ORDER BY c) AS before FROM g)
SELECT o_orderpriority, c, CASE WHEN before IS NULL OR c - 0.5 > before THEN c - 0.5 ELSE c END::DOUBLE AS refined FROM l""")
def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a step below each grid point, where that is above the one before."""
    g = table(spark, sf_dir, "orders").select("o_orderpriority", (F.ceil(F.col("o_totalprice") / 5000) / 2.0).alias("c")).distinct()
    before = F.lag("c").over(Window.partitionBy("o_orderpriority").orderBy("c"))
    return g.select("o_orderpriority", "c", F.when(before.isNull() | (F.col("c") - 0.5 > before), F.col("c") - 0.5).otherwise(F.col("c")).cast("double").alias("refined"))


@query("t13_most_candidates", """SELECT p_size, max_by(p_partkey, (p_retailprice, -p_partkey)) AS best FROM part GROUP BY 1""")
def most_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("best"))


@query("u1_u6_merged_labels", """SELECT x::INT AS x, y::INT AS y, string_agg(label, ' / ' ORDER BY label) AS labels FROM (SELECT DISTINCT n_regionkey AS x, length(n_name) AS y, n_name AS label FROM nation UNION ALL SELECT r_regionkey, length(r_name), r_name FROM region) GROUP BY 1, 2""")
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of points that coincide, merged."""
    a = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("x"), F.length("n_name").alias("y"), F.col("n_name").alias("label")).distinct()
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("x"), F.length("r_name").alias("y"), F.col("r_name").alias("label"))
    return a.unionByName(b).groupBy("x", "y").agg(F.array_join(F.array_sort(F.collect_list("label")), " / ").alias("labels"))


@query("m4_mock_failure", f"""WITH {SQL_STRANDS} SELECT doc_id, chunk, round(exp(-6.0 / greatest(1e-9, 0.02 * length(strand) * pow(1.3, pow(greatest(0, {SQL_RUN} - 2), 1.5)) * (1 + 2 * abs({SQL_GC} - 0.5)))), 9) AS p FROM strands""")
def mock_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure probability of a strand at six reads by a stand-in for difficulty."""
    s = F.col("strand")
    d = 0.02 * F.length(s) * F.pow(F.lit(1.3), F.pow(F.greatest(F.lit(0), S.max_run_length(s) - 2).cast("double"), F.lit(1.5))) * (1 + 2 * F.abs(S.gc_fraction(s) - 0.5))
    return document_strands(spark, sf_dir, "doc_id").select("doc_id", "chunk", F.round(F.exp(-6.0 / F.greatest(F.lit(1e-9), d)), 9).alias("p"))


@query("m3_m5_moments", f"""WITH {SQL_STRANDS}, v AS (SELECT lang, {SQL_RUN}::DOUBLE AS run, abs({SQL_GC} - 0.5) AS dev, length(strand)::DOUBLE AS len FROM strands)
SELECT lang, round(corr(run, dev), 6) AS run_dev, round(regr_slope(run, dev), 6) AS slope, round(avg(run * dev), 6) AS cross_moment, round(avg(dev * dev), 9) AS second FROM v GROUP BY 1""")
def feature_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of hand-made features, from which a least-squares scorer follows."""
    s = F.col("strand")
    v = document_strands(spark, sf_dir, "lang").select("lang", S.max_run_length(s).cast("double").alias("run"), F.abs(S.gc_fraction(s) - 0.5).alias("dev"))
    return v.groupBy("lang").agg(F.round(F.corr("run", "dev"), 6).alias("run_dev"), F.round(F.regr_slope("run", "dev"), 6).alias("slope"), F.round(F.avg(F.col("run") * F.col("dev")), 6).alias("cross_moment"), F.round(F.avg(F.col("dev") * F.col("dev")), 9).alias("second"))


@query("e2_early_exit", """WITH t AS (SELECT o_custkey % 12 + 1 AS coverage, o_orderstatus = 'O' AS miss, row_number() OVER (PARTITION BY o_custkey % 12 ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey % 12) AS n FROM orders),
c AS (SELECT *, sum(miss::INT) OVER (PARTITION BY coverage ORDER BY k) AS misses FROM t) SELECT coverage, min(k) FILTER (WHERE misses > floor(0.4 * n + 1e-9))::BIGINT AS stopped_at, max(misses) <= floor(0.4 * max(n) + 1e-9) AS meets FROM c GROUP BY 1""")
def early_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial, in seed order, at which a target can no longer be met, for each coverage."""
    t = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 12 + 1).alias("coverage"), "o_orderkey", (F.col("o_orderstatus") == "O").cast("int").alias("miss"))
    c = placed(t, ["coverage"], ["o_orderkey"], {"misses": F.col("miss")}).select("coverage", (F.col("i") + 1).alias("k"), "misses", F.floor(0.4 * F.col("n") + 1e-9).alias("allowed"))
    return c.groupBy("coverage").agg(F.min(F.when(F.col("misses") > F.col("allowed"), F.col("k"))).cast("long").alias("stopped_at"), (F.max("misses") <= F.max("allowed")).alias("meets"))


@query("e8_ladder", """WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey, chr(65 + CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN 2 ELSE 1 END::INT) AS stage FROM s WHERE i IN (0, n // 2, n - 1)""")
def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last iteration of each run, as stages."""
    w = Window.partitionBy("o_custkey")
    s = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    s = s.where((F.col("i") == 0) | (F.col("i") == F.floor(F.col("n") / 2)) | (F.col("i") == F.col("n") - 1))
    return s.select("o_custkey", "o_orderkey", F.when(F.col("i") == 0, "A").when(F.col("i") == F.col("n") - 1, "C").otherwise("B").alias("stage"))


@query("q6_q16_mixtures", f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'uniform' WHEN 1 THEN 'runs' ELSE 'biased' END AS family, CASE WHEN {sql_uniform("o_orderkey", "'which'", "7")} < 0.5 THEN 1 + floor({sql_uniform("o_orderkey", "'n'", "7")} * 6) ELSE 1 + floor({sql_uniform("o_orderkey", "'n'", "7")} * 16) END::BIGINT AS n_reads FROM orders""")
def mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family by turns, and a coverage from a mixture of two uniform laws."""
    k = F.col("o_orderkey")
    n = S.uniform(k, "n", 7)
    return table(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, "uniform").when(k % 3 == 1, "runs").otherwise("biased").alias("family"), F.when(S.uniform(k, "which", 7) < 0.5, 1 + F.floor(n * 6)).otherwise(1 + F.floor(n * 16)).alias("n_reads"))


@query("q12_q13_plans", """WITH r AS (SELECT l_suppkey, count(*) AS refs, avg(l_quantity) AS len, avg(l_discount) + 0.001 AS rate FROM lineitem GROUP BY 1) SELECT l_suppkey, least(60, greatest(12, ceil(150000 / (refs * len * rate))))::BIGINT AS reads, l_suppkey % 10 * (1000 // 10) AS block_start FROM r""")
def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated reads for each reference within bounds, and the start of a block of held-out seeds."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("refs"), F.avg("l_quantity").alias("len"), (F.avg("l_discount") + 0.001).alias("rate"))
    return r.select("l_suppkey", F.least(F.lit(60), F.greatest(F.lit(12), F.ceil(150000 / (F.col("refs") * F.col("len") * F.col("rate"))))).cast("long").alias("reads"), (F.col("l_suppkey") % 10 * 100).alias("block_start"))


@query("q18_sinusoids", """SELECT p_partkey, round(sin(p_size / pow(10000, 2 * (p_partkey % 8) / 16.0)), 9) AS s, round(cos(p_size / pow(10000, 2 * (p_partkey % 8) / 16.0)), 9) AS c FROM part""")
def sinusoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size") / F.pow(F.lit(10000.0), 2 * (F.col("p_partkey") % 8) / 16.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.sin(x), 9).alias("s"), F.round(F.cos(x), 9).alias("c"))


@query("f30_formatted_settings", """SELECT p_partkey, CASE WHEN p_size = 1 THEN 'off' WHEN p_size < 10 THEN '<= ' || p_size ELSE p_size || ' to ' || (p_size + 5) END AS setting, replace(regexp_extract(p_brand, '#([0-9]+)', 1), '1', 'one ') AS pretty FROM part""")
def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    text = F.when(n == 1, "off").when(n < 10, F.concat(F.lit("<= "), n)).otherwise(F.concat(n, F.lit(" to "), n + 5))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("setting"), F.replace(F.regexp_extract("p_brand", "#([0-9]+)", 1), F.lit("1"), F.lit("one ")).alias("pretty"))


@query("f28_run_events", f"""WITH {SQL_BENCH}, p AS (SELECT strand_id, strand, unnest(range(1, length(strand) + 1)) AS pos FROM strands), b AS (SELECT strand_id, pos, substr(strand, pos, 1) AS base FROM p),
e AS (SELECT strand_id, pos, base IS DISTINCT FROM lead(base) OVER (PARTITION BY strand_id ORDER BY pos) AS run_end, base IS DISTINCT FROM lag(base) OVER (PARTITION BY strand_id ORDER BY pos) AS run_start FROM b),
r AS (SELECT *, pos - max(CASE WHEN run_start THEN pos END) OVER (PARTITION BY strand_id ORDER BY pos ROWS UNBOUNDED PRECEDING) + 1 AS run FROM e) SELECT strand_id, pos::INT AS pos, run::INT AS run, round(1 - exp(-0.05 * (run - 1)), 9) AS p FROM r WHERE run_end""")
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of an extra event at the end of each run."""
    r = benchmark_strands(spark, sf_dir).select("strand_id", F.explode(S.runs(F.col("strand"))).alias("r"))
    return r.select("strand_id", (F.col("r.first_pos") + F.col("r.run") - 1).alias("pos"), "r.run", F.round(1 - F.exp(-0.05 * (F.col("r.run") - 1)), 9).alias("p"))


@query("m2_kmer_risk")
def learned_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer of strands learned from two of three items, and how well it ranks the strands of the others by whether they break a rule."""
    from strandlake.functions.ranking import roc_auc
    from strandlake.operators import risk

    s = benchmark_strands(spark, sf_dir)
    s = s.withColumn("bad", ~S.passes_rules(F.col("strand"))).withColumn("held_out", F.crc32(F.col("item_id").cast("string").cast("binary")) % 3 == 1)
    model = risk.fit(s.where("not held_out").select("strand", F.when(F.col("bad"), 0.95).otherwise(0.05).alias("risk")))
    scored = risk.score(s.select("strand_id", "strand", "bad", "held_out"), model).withColumn("risk_score", F.round("risk_score", 6))
    return roc_auc(scored, "risk_score", "bad", ["held_out"]).select("held_out", "n_pos", "n_neg", F.round("auc", 4).alias("auc"))


@query("p7_guarded_seeds", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderkey NOT BETWEEN 900000 AND 900999 GROUP BY 1")
def guarded_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over trials whose seeds may be trained on: the one pass that makes them counts wrong seeds too, and the result is given out only if there were none."""
    guard = SeedGuard()
    trials = table(spark, sf_dir, "orders").where(~F.col("o_orderkey").between(guard.start, guard.start + guard.count - 1))
    out = written(guard.watch(trials, "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")), "guarded")
    guard.check()
    return out
