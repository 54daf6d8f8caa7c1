"""How likely each base of a strand is to be lost, changed, or preceded by another, as arrays within the strand's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.strands import runs

#: Fixed value: the most that the three probabilities of a base add up to.
MOST = 0.5


def error_multipliers(s: Column, end_factor: float, homopolymer: float = 1.0, run_factors: list[float] | None = None) -> Column:
    """Array of struct(dele, other) for the bases of a strand: a ramp from 1 to end_factor, times what the run does that a base is in.

    Without run_factors each further base of a run multiplies all by homopolymer; with them (for runs of 1, 2, ...; the last for all longer ones) they multiply deletions only.
    """
    n = F.length(s)
    inside = F.flatten(F.transform(runs(s), lambda r: F.array_repeat(r.run, r.run)))

    def one(run: Column, pos: Column) -> Column:
        ramp = 1.0 + (end_factor - 1.0) * pos / F.greatest(n - 1, F.lit(1))
        if run_factors:
            return F.struct((ramp * F.get(F.array(*map(F.lit, run_factors)), F.least(run, F.lit(len(run_factors))) - 1)).alias("dele"), ramp.alias("other"))
        both = ramp * F.pow(F.lit(homopolymer), (run - 1).cast("double"))
        return F.struct(both.alias("dele"), both.alias("other"))

    return F.transform(inside, one)


def base_probabilities(multipliers: Column, sub: float, ins: float, dele: float, context: Column | None = None) -> Column:
    """Array of struct(dele, ins, sub) from error_multipliers(); context: an array of struct(sub, ins, dele) of further factors of each base."""

    def one(m: Column, c: Column | None) -> Column:
        f = lambda x, name: x if c is None else x * c[name]
        return F.struct(f(dele * m.dele, "dele").alias("dele"), f(ins * m.other, "ins").alias("ins"), f(sub * m.other, "sub").alias("sub"))

    return F.transform(multipliers, lambda m: one(m, None)) if context is None else F.zip_with(multipliers, context, one)


def cap_probabilities(p: Column, most: float = MOST) -> Column:
    """The same, where the three together are more than most scaled down to it."""

    def one(x: Column) -> Column:
        total = x.dele + x.ins + x.sub
        scale = F.when(total > most, most / F.greatest(total, F.lit(1e-12))).otherwise(1.0)
        return F.struct(*((x[c] * scale).alias(c) for c in ("dele", "ins", "sub")))

    return F.transform(p, one)


def second_context(table: DataFrame, used: DataFrame, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """One row with arrays a and b, by number of context: the multipliers of table (kmer, a; all contexts of a length), and a second set of half their log amplitude, clipped to low and high.

    b is scaled so that its mean over used (kmer, n: how often each context is met) is a's; contexts that are never met count for nothing.
    """
    t = table.withColumn("b", F.least(F.lit(high), F.greatest(F.lit(low), F.sqrt("a")))).join(used, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    scale = F.coalesce(F.sum(F.col("a") * F.col("n")) / F.sum(F.col("b") * F.col("n")), F.lit(1.0))
    one = t.agg(F.array_sort(F.collect_list(F.struct("kmer", "a", "b"))).alias("t"), scale.alias("scale"))
    return one.select(F.transform("t", lambda x: x.a).alias("a"), F.transform("t", lambda x: x.b * F.col("scale")).alias("b"))
