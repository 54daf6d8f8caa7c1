"""Ranking statistics and intervals as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def midrank(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Average ranks of value within groups, by counts of each value first: the window sees one row for each distinct value."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = n.withColumn(out, F.sum("__n").over(w) - (F.col("__n") - 1) / 2)
    return df.join(n.drop("__n"), [*by, value])


def roc_auc(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """by, n_pos, n_neg, auc: the share of (positive, negative) pairs in order, ties half; NaN if a class is empty.

    Works on counts of each distinct score, so that no pair and no row is enumerated.
    """
    c = df.groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("won", F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2))
    t = c.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("won").alias("won"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos") * F.col("n_neg"))).otherwise(NAN)
    return t.select(*by, "n_pos", "n_neg", auc.alias("auc"))


def stratified_auc(df: DataFrame, score: str, positive: str, stratum: str, by: list[str]) -> DataFrame:
    """by, auc: areas of strata pooled with the number of their pairs; strata with one class have none."""
    s = roc_auc(df, score, positive, [*by, stratum]).withColumn("w", F.col("n_pos") * F.col("n_neg")).where("w > 0")
    return s.groupBy(*by).agg((F.sum(F.col("auc") * F.col("w")) / F.sum("w")).alias("auc"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, rho: Pearson correlation of average ranks; NaN if either is constant."""
    r = midrank(midrank(df, x, by, "__x"), y, by, "__y")
    flat = (F.stddev_pop("__x") == 0) | (F.stddev_pop("__y") == 0)
    return r.groupBy(*by).agg(F.when(flat, NAN).otherwise(F.corr("__x", "__y")).alias("rho"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of a share; (0, 1) without trials."""
    p, z2 = hits / F.nullif(n, F.lit(0)), z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / (1 + z2 / n))).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / (1 + z2 / n))).otherwise(1.0))


def robust_slope(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, slope, low, high: least squares with a 95% interval that allows unequal variances (HC0)."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("b"), F.avg(x).alias("mx"), F.sum(F.lit(1)).alias("n"))
    d = df.join(fit, by)
    dx, e = F.col(x) - F.col("mx"), F.col(y) - F.col("slope") * F.col(x) - F.col("b")
    v = d.groupBy(*by, "slope").agg(F.sum(dx * dx * e * e).alias("top"), F.sum(dx * dx).alias("sxx"))
    half = 1.959963984540054 * F.sqrt("top") / F.col("sxx")
    return v.select(*by, "slope", (F.col("slope") - half).alias("low"), (F.col("slope") + half).alias("high"))
