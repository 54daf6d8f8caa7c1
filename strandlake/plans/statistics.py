"""Queries on ranking statistics, aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import ranking as R
from strandlake.functions import strands as S
from strandlake.operators.ordering import ntile, numbered, placed
from strandlake.plans.base import SQL_BENCH, SQL_GC, SQL_RUN, SQL_STRANDS, benchmark_strands, document_strands, query, sql_uniform, table

_LABELLED = "scored AS (SELECT lang, source, quality = 1 AS good, n_chars AS score FROM documents JOIN labels USING (doc_id))"
_AUC = """ranked AS (SELECT {by}, good, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS r FROM scored),
auc AS (SELECT {by}, count(*) FILTER (WHERE good) AS n_pos, count(*) FILTER (WHERE NOT good) AS n_neg,
CASE WHEN count(*) FILTER (WHERE good) > 0 AND count(*) FILTER (WHERE NOT good) > 0 THEN
(sum(CASE WHEN good THEN r END) - count(*) FILTER (WHERE good) * (count(*) FILTER (WHERE good) + 1) / 2.0) / (count(*) FILTER (WHERE good) * count(*) FILTER (WHERE NOT good)) ELSE 'nan'::DOUBLE END AS auc FROM ranked GROUP BY {by})"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: whether quality is good, and a score to rank by."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "source", "score", (F.col("quality") == 1).alias("good"))


@query("a23_roc_auc", f"WITH {_LABELLED}, {_AUC.format(by='lang')} SELECT lang, n_pos, n_neg, round(auc, 9) AS auc FROM auc")
def auc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.roc_auc(scored(spark, sf_dir), "score", "good", ["lang"]).withColumn("auc", F.round("auc", 9))


@query("a25_stratified_auc", f"WITH {_LABELLED}, {_AUC.format(by='lang, source')} SELECT lang, round(sum(auc * n_pos * n_neg) / sum(n_pos * n_neg), 9) AS auc FROM auc WHERE n_pos * n_neg > 0 GROUP BY lang")
def auc_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stratified_auc(scored(spark, sf_dir), "score", "good", "source", ["lang"]).withColumn("auc", F.round("auc", 9))


@query("a24_spearman", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS y FROM lineitem) SELECT l_returnflag, round(corr(x, y), 9) AS rho FROM r GROUP BY 1""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    return R.spearman(rows, "l_quantity", "l_discount", ["l_returnflag"]).withColumn("rho", F.round("rho", 9))


@query("a26_ranking_summary", f"WITH {_LABELLED}, {_AUC.format(by='source')} SELECT source, round(auc, 9) AS auc, round(n_pos::DOUBLE / (n_pos + n_neg), 9) AS share FROM auc")
def ranking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.roc_auc(scored(spark, sf_dir), "score", "good", ["source"])
    return r.select("source", F.round("auc", 9).alias("auc"), F.round(F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")), 9).alias("share"))


_Z = 1.959963984540054


@query("a19_wilson", f"""WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1), p AS (SELECT *, k / n AS p FROM c)
SELECT o_orderpriority, k::BIGINT AS hits, n::BIGINT AS n, round(greatest(0, (p + {_Z * _Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n)), 9) AS low,
round(least(1, (p + {_Z * _Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n)), 9) AS high FROM p""")
def recovery_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count("*").alias("n"))
    low, high = R.wilson(F.col("hits"), F.col("n"))
    return c.select("o_orderpriority", "hits", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("a18_robust_slope", f"""WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS mx FROM lineitem GROUP BY 1),
v AS (SELECT l_returnflag, s, sqrt(sum((l_quantity - mx) * (l_quantity - mx) * (l_extendedprice - s * l_quantity - b) * (l_extendedprice - s * l_quantity - b))) / sum((l_quantity - mx) * (l_quantity - mx)) AS se FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1, 2)
SELECT l_returnflag, round(s, 4) AS slope, round(s - {_Z} * se, 4) AS low, round(s + {_Z} * se, 4) AS high FROM v""")
def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.robust_slope(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("slope", "low", "high")))


@query("a13_a14_fits", """SELECT l_linenumber, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
round(exp(sum(l_quantity * (l_linenumber + 1) * ln(1 + l_discount)) / sum(l_quantity * (l_linenumber + 1) * (l_linenumber + 1))), 9) AS factor FROM lineitem GROUP BY 1""")
def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight-line fits, and a weighted fit of log ratios through the origin."""
    r, w = F.col("l_linenumber") + 1, F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"),
        F.round(F.exp(F.sum(w * r * F.log1p("l_discount")) / F.sum(w * r * r)), 9).alias("factor"),
    )


@query("a16_a17_coverage_moments", """WITH c AS (SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY 1), m AS (SELECT c_mktsegment, coalesce(n, 0) AS n FROM customer LEFT JOIN c ON o_custkey = c_custkey)
SELECT c_mktsegment, round(avg(n), 9) AS mean, round(var_pop(n), 9) AS variance, round(CASE WHEN var_pop(n) > avg(n) THEN avg(n) * avg(n) / (var_pop(n) - avg(n)) ELSE 1000 END, 6) AS shape, median(n) AS median, round(avg(CASE WHEN n <= 3 THEN 1.0 ELSE 0 END), 9) AS thin FROM m GROUP BY 1""")
def coverage_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads for each strand (orders of each customer; none counts as 0): moments, shape of the negative binomial, share with three or fewer."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"))
    m = table(spark, sf_dir, "customer").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_mktsegment", F.coalesce("n", F.lit(0.0)).alias("n"))
    mean, var = F.avg("n"), F.var_pop("n")
    return m.groupBy("c_mktsegment").agg(
        F.round(mean, 9).alias("mean"), F.round(var, 9).alias("variance"), F.round(F.when(var > mean, mean * mean / (var - mean)).otherwise(1000.0), 6).alias("shape"),
        F.median("n").alias("median"), F.round(F.avg((F.col("n") <= 3).cast("double")), 9).alias("thin"),
    )


@query("a15_negative_binomial_shape", """WITH c AS (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1), h AS (SELECT v, count(*) AS n FROM c GROUP BY 1), m AS (SELECT sum(n * v)::DOUBLE / sum(n) AS mu FROM h),
g AS (SELECT i, exp(-1.0 + i * 0.05) AS k FROM range(160) t(i)), j AS (SELECT v, unnest(range(0, v)) AS j FROM h),
r AS (SELECT v, k, i, sum(ln(k + j)) AS rising FROM j, g GROUP BY 1, 2, 3),
l AS (SELECT i, k, sum(n * (rising + k * ln(k / (k + mu)) + h.v * ln(mu / (k + mu)))) AS loglik FROM h JOIN r ON r.v = h.v, m GROUP BY 1, 2)
SELECT i::BIGINT AS grid_point, round(k, 6) AS shape FROM l ORDER BY loglik DESC, i LIMIT 1""")
def shape_by_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of greatest likelihood on a grid. Gamma ratios are sums of logarithms, and only the histogram meets the grid."""
    h = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    mu = h.agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mu"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(159)), lambda i: F.struct(i.alias("i"), F.exp(-1.0 + i * 0.05).alias("k")))
    each = h.crossJoin(F.broadcast(mu)).withColumn("g", F.explode(grid)).select("v", "n", "mu", "g.*")  # mu is one row
    rising = F.aggregate(F.sequence(F.lit(0), (F.col("v") - 1).cast("int")), F.lit(0.0), lambda a, j: a + F.log(F.col("k") + j))
    loglik = F.col("n") * (rising + F.col("k") * F.log(F.col("k") / (F.col("k") + F.col("mu"))) + F.col("v") * F.log(F.col("mu") / (F.col("k") + F.col("mu"))))
    best = each.groupBy("i", "k").agg(F.sum(loglik).alias("loglik")).orderBy(F.desc("loglik"), "i").limit(1)
    return best.select(F.col("i").cast("long").alias("grid_point"), F.round("k", 6).alias("shape"))


_RISING = "list_sum(list_transform(range(0, v::BIGINT), lambda j: ln(k + j)))"


@query("a15_refined_shape", f"""WITH c AS (SELECT l_orderkey, ceil(sum(l_quantity) / 10)::BIGINT AS v FROM lineitem GROUP BY 1), h AS (SELECT v, count(*) AS n FROM c GROUP BY 1), m AS (SELECT sum(n * v)::DOUBLE / sum(n) AS mu FROM h),
g AS (SELECT i, exp(ln(0.05::DOUBLE) + i * (ln(1000::DOUBLE) - ln(0.05::DOUBLE)) / 399) AS k FROM range(400) t(i)),
l AS (SELECT i, k, sum(n * ({_RISING} + k * ln(k / (k + mu)) + v * ln(mu / (k + mu)))) AS loglik FROM h, g, m GROUP BY 1, 2),
b AS (SELECT i FROM l ORDER BY loglik DESC, i LIMIT 1), e AS (SELECT b.i, (SELECT k FROM g WHERE g.i = greatest(b.i - 1, 0)) AS lo, (SELECT k FROM g WHERE g.i = least(b.i + 1, 399)) AS hi FROM b),
f AS (SELECT e.i, j, lo + j * (hi - lo) / 199 AS k FROM e, range(200) t(j)),
r AS (SELECT i, j, k, sum(n * ({_RISING} + k * ln(k / (k + mu)) + v * ln(mu / (k + mu)))) AS loglik FROM h, f, m GROUP BY 1, 2, 3)
SELECT i::INT AS coarse, j::INT AS fine, round(k, 6) AS shape FROM r ORDER BY loglik DESC, j LIMIT 1""")
def refined_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of greatest likelihood: the best of 400 points a constant factor apart, then of 200 evenly between its neighbours. Only the histogram (of tens of units an order) meets either."""
    h = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.ceil(F.sum("l_quantity") / 10).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    mu = h.agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mu"))
    each = h.crossJoin(F.broadcast(mu))  # mu is one row
    low, high = math.log(0.05), math.log(1000.0)
    point = lambda i: F.exp(F.lit(low) + i * F.lit(high - low) / 399)

    def loglik(k: Column) -> Column:
        rising = F.when(F.col("v") > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("v") - 1, F.lit(0)).cast("int")), F.lit(0.0), lambda a, j: a + F.log(k + j))).otherwise(0.0)
        return F.sum(F.col("n") * (rising + k * F.log(k / (k + F.col("mu"))) + F.col("v") * F.log(F.col("mu") / (k + F.col("mu")))))

    def best(points: DataFrame, by: list[str]) -> DataFrame:
        found = points.groupBy(*by, "k").agg(loglik(F.col("k")).alias("l"))
        return found.agg(F.max_by(F.struct(*by, "k"), F.struct("l", (-F.col(by[-1])).alias("first"))).alias("b")).select("b.*")

    coarse = best(each.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(399)))).withColumn("k", point(F.col("i"))), ["i"])
    ends = coarse.select("i", point(F.greatest(F.col("i") - 1, F.lit(0))).alias("lo"), point(F.least(F.col("i") + 1, F.lit(399))).alias("hi"))
    fine = each.crossJoin(F.broadcast(ends)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(199))))  # ends is one row
    b = best(fine.withColumn("k", F.col("lo") + F.col("j") * (F.col("hi") - F.col("lo")) / 199), ["i", "j"])
    return b.select(F.col("i").alias("coarse"), F.col("j").alias("fine"), F.round("k", 6).alias("shape"))


@query("a11_a12_shrunk_rates", f"""WITH {SQL_STRANDS}, e AS (SELECT lang, {SQL_RUN} AS bucket, count(*) AS n, count(*) FILTER (WHERE {SQL_GC} > 0.5) AS e FROM strands GROUP BY 1, 2),
g AS (SELECT *, sum(e) OVER (PARTITION BY lang)::DOUBLE / sum(n) OVER (PARTITION BY lang) AS rate, sum(n) OVER (PARTITION BY lang) AS total FROM e), r AS (SELECT *, (e + 2000 * rate) / (n + 2000) / rate AS rel FROM g WHERE rate > 0)
SELECT lang, bucket, round(rel, 9) AS relative, round(rel / sum(rel * n / total) OVER (PARTITION BY lang), 9) AS normalised FROM r""")
def shrunk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by run length relative to the language's, shrunk towards 1, and normalised to a weighted mean of 1."""
    s = F.col("strand")
    e = document_strands(spark, sf_dir, "lang").groupBy("lang", S.max_run_length(s).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(S.gc_fraction(s) > 0.5).alias("e"))
    w = Window.partitionBy("lang")
    g = e.withColumn("rate", F.sum("e").over(w) / F.sum("n").over(w)).withColumn("total", F.sum("n").over(w)).where("rate > 0")
    r = g.withColumn("rel", (F.col("e") + 2000 * F.col("rate")) / (F.col("n") + 2000) / F.col("rate"))
    return r.select("lang", "bucket", F.round("rel", 9).alias("relative"), F.round(F.col("rel") / F.sum(F.col("rel") * F.col("n") / F.col("total")).over(w), 9).alias("normalised"))


@query("a20_reference_stats", f"""WITH {SQL_STRANDS}, v AS (SELECT source, {SQL_GC} AS gc, {SQL_RUN} AS run FROM strands)
SELECT source, count(*) AS n, round(avg(gc), 9) AS gc_mean, round(stddev_pop(gc), 9) AS gc_sd, round(min(gc), 9) AS gc_min, round(max(gc), 9) AS gc_max, round(avg(CASE WHEN run >= 4 THEN 1.0 ELSE 0 END), 9) AS run4_share FROM v GROUP BY 1""")
def reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = document_strands(spark, sf_dir, "source").select("source", S.gc_fraction(F.col("strand")).alias("gc"), S.max_run_length(F.col("strand")).alias("run"))
    return v.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("gc"), 9).alias("gc_mean"), F.round(F.stddev_pop("gc"), 9).alias("gc_sd"), F.round(F.min("gc"), 9).alias("gc_min"), F.round(F.max("gc"), 9).alias("gc_max"), F.round(F.avg((F.col("run") >= 4).cast("double")), 9).alias("run4_share"))


@query("a22_j17_band_tables", f"""WITH {SQL_STRANDS}, v AS (SELECT {SQL_GC} AS gc, {SQL_RUN} AS run FROM strands), bins AS (SELECT * FROM (VALUES ('low', 0.0, 0.4), ('mid', 0.4, 0.6), ('high', 0.6, 1.01)) b(bin, lo, hi))
SELECT bin, count(*) AS n, round(avg(run), 9) AS mean_run, round(avg(gc), 9) AS mean_gc FROM v JOIN bins ON gc >= lo AND gc < hi GROUP BY bin""")
def band_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = spark.createDataFrame([("low", 0.0, 0.4), ("mid", 0.4, 0.6), ("high", 0.6, 1.01)], "bin string, lo double, hi double")
    v = document_strands(spark, sf_dir).select(S.gc_fraction(F.col("strand")).alias("gc"), S.max_run_length(F.col("strand")).alias("run"))
    return v.join(F.broadcast(bins), (F.col("gc") >= F.col("lo")) & (F.col("gc") < F.col("hi"))).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("run"), 9).alias("mean_run"), F.round(F.avg("gc"), 9).alias("mean_gc"))


@query("a27_paired_bootstrap", f"""WITH x AS (SELECT o_custkey % 1000 AS seed, avg((o_orderstatus = 'F')::INT) AS r FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), y AS (SELECT o_custkey % 1000 AS seed, avg((o_orderstatus = 'F')::INT) AS r FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1),
d AS (SELECT row_number() OVER (ORDER BY seed) - 1 AS i, y.r - x.r AS diff FROM x JOIN y USING (seed)),
n AS (SELECT count(*) AS n FROM d), draws AS (SELECT b.b, floor({sql_uniform("b.b", "k.k")} * n)::BIGINT AS i FROM n, range(2000) b(b), (SELECT i AS k FROM d) k),
m AS (SELECT b, avg(diff) AS mean FROM draws JOIN d USING (i) GROUP BY b) SELECT (SELECT round(avg(diff), 9) FROM d) AS mean, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM m""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of trials that are paired by seed, with a 95% interval from 2,000 resamples of the pairs that keyed numbers draw."""
    o = table(spark, sf_dir, "orders").withColumn("seed", F.col("o_custkey") % 1000).withColumn("ok", (F.col("o_orderstatus") == "F").cast("int"))
    x, y = (o.where(F.col("o_orderpriority") == p).groupBy("seed").agg(F.avg("ok").alias(n)) for p, n in (("1-URGENT", "x"), ("5-LOW", "y")))
    d = x.join(y, "seed").select((F.row_number().over(Window.orderBy("seed")) - 1).cast("long").alias("i"), (F.col("y") - F.col("x")).alias("diff"))
    n = d.agg(F.count("*").alias("n"), F.round(F.avg("diff"), 9).alias("whole"))
    draws = spark.range(2000).select(F.col("id").alias("b")).repartition(32, "b").crossJoin(F.broadcast(d.select(F.col("i").alias("k")).crossJoin(n)))  # a pair for each of 1,000 seeds at most
    draws = draws.withColumn("i", F.floor(S.uniform(F.col("b"), F.col("k")) * F.col("n")))
    means = draws.join(F.broadcast(d), "i").groupBy("b", "whole").agg(F.avg("diff").alias("m"))
    return means.groupBy(F.col("whole").alias("mean")).agg(F.round(F.percentile("m", F.lit(0.025)), 9).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 9).alias("high"))


@query("a28_threshold_quantiles", f"""WITH {SQL_STRANDS}, v AS (SELECT lang, {SQL_GC} AS score, {SQL_RUN} <= 3 AS ok FROM strands),
q AS (SELECT lang, unnest([0.1, 0.25, 0.5]) AS q FROM (SELECT DISTINCT lang FROM v)), a AS (SELECT lang, count(*) FILTER (WHERE ok) AS n FROM v GROUP BY 1)
SELECT q.lang, q.q::DOUBLE AS q, round(CASE WHEN any_value(a.n) >= 20 THEN CASE q.q WHEN 0.1 THEN quantile_cont(CASE WHEN ok THEN score END, 0.1) WHEN 0.25 THEN quantile_cont(CASE WHEN ok THEN score END, 0.25) ELSE quantile_cont(CASE WHEN ok THEN score END, 0.5) END
ELSE CASE q.q WHEN 0.1 THEN quantile_cont(score, 0.1) WHEN 0.25 THEN quantile_cont(score, 0.25) ELSE quantile_cont(score, 0.5) END END, 9) AS threshold FROM q JOIN v USING (lang) JOIN a USING (lang) GROUP BY q.lang, q.q""")
def threshold_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score quantiles of strands that pass the run rule, or of all where fewer than 20 do."""
    v = document_strands(spark, sf_dir, "lang").select("lang", S.gc_fraction(F.col("strand")).alias("score"), (S.max_run_length(F.col("strand")) <= 3).alias("ok"))
    qs = F.array(*map(F.lit, (0.1, 0.25, 0.5)))
    t = v.groupBy("lang").agg(F.count_if("ok").alias("n"), F.percentile(F.when(F.col("ok"), F.col("score")), qs).alias("own"), F.percentile("score", qs).alias("every"))
    z = F.arrays_zip(qs.alias("q"), F.when(F.col("n") >= 20, F.col("own")).otherwise(F.col("every")).alias("t"))
    return t.select("lang", F.explode(z).alias("z")).select("lang", F.col("z.q").alias("q"), F.round(F.col("z.t"), 9).alias("threshold"))


@query("w3_deciles", """WITH d AS (SELECT o_totalprice, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS decile FROM orders) SELECT decile::INT AS decile, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM d GROUP BY 1""")
def deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = numbered(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"])
    n = o.agg(F.count("*").alias("rows"))
    d = o.crossJoin(F.broadcast(n)).select("o_totalprice", ntile(F.col("i"), F.col("rows"), 10).alias("decile"))  # one row
    return d.groupBy("decile").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("w1_w2_ranks", """WITH n AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS o, count(*) OVER (PARTITION BY c_mktsegment) AS n,
rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS midrank FROM customer) SELECT c_custkey, round(midrank, 1)::DOUBLE AS midrank, round((o - 1)::DOUBLE / (n - 1), 9) AS percentile FROM n""")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.midrank(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_acctbal", ["c_mktsegment"], "midrank")
    r = placed(r, ["c_mktsegment"], ["c_acctbal", "c_custkey"])
    return r.select("c_custkey", F.round("midrank", 1).cast("double").alias("midrank"), F.round(F.col("i") / (F.col("n") - 1), 9).alias("percentile"))


@query("a4_grouping_sets", """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus))""")
def pooled_and_by_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_for_sets")
    return spark.sql("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders_for_sets GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus))")


@query("a29_upper_median", """WITH v AS (SELECT o_custkey % 100 AS block, list_sort(list(CASE WHEN o_orderstatus = 'P' THEN 'inf'::DOUBLE ELSE o_totalprice END)) AS l FROM orders GROUP BY 1) SELECT block, l[len(l) // 2 + 1] AS median FROM v""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median where a missing value counts as infinite."""
    v = F.when(F.col("o_orderstatus") == "P", float("inf")).otherwise(F.col("o_totalprice"))
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("block"), v.alias("median"))
    return placed(o, ["block"], ["median"]).where("i = n div 2").select("block", "median")


@query("w7_forward_fill", """SELECT o_orderkey, last_value(CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS filled FROM orders""")
def forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.last(F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")), ignorenulls=True).over(w).alias("filled"))


@query("w13_sliding_windows", """WITH w AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS k FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 6) DESC, event_id) AS rk FROM w WHERE k = 6) SELECT user_id, event_id, round(s, 6) AS gap FROM r WHERE rk = 1""")
def widest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the window of six events with the largest sum."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(0, 5)
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.sum("value").over(w), 6).alias("gap"), F.count("*").over(w).alias("k")).where("k = 6")
    return s.withColumn("rk", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("gap"), "event_id"))).where("rk = 1").select("user_id", "event_id", "gap")
