"""What a scorer of strands has learned: designed strands, scored together, and means by what was written into them.

Designs are made of backgrounds (strand_id, strand): rows times a ladder that is written down by hand, or all k-mers of a length. Places and letters are keyed
draws, so the same backgrounds give the same designs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.strands import BASES, max_run_length, uniform


def _place(room: Column, *keys: Column | str) -> Column:
    """A place from 1 that leaves so much room after it."""
    return (1 + F.floor(uniform(F.col("strand_id"), *keys) * room)).cast("int")


def _written(at: Column, what: Column) -> Column:
    return F.concat(F.substring("strand", F.lit(1), at - 1), what, F.substring("strand", at + F.length(what), F.length("strand")))


def kmer_designs(backgrounds: DataFrame, k: int) -> DataFrame:
    """(strand_id, probe, strand): every k-mer over the four bases in every background that is long enough, at one place of the background for all of them."""
    letters = [F.substring(F.lit(BASES), (F.floor(F.col("number") / 4**j) % 4 + 1).cast("int"), F.lit(1)) for j in range(k - 1, -1, -1)]
    d = backgrounds.where(F.length("strand") >= k).withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(4**k - 1)))).withColumn("probe", F.concat(*letters))
    return d.select("strand_id", "probe", _written(_place(F.length("strand") - k + 1, "probe"), F.col("probe")).alias("strand"))


def run_designs(backgrounds: DataFrame, lengths: list[int]) -> DataFrame:
    """(strand_id, probe, strand): a run of each length in every background longer than it by two; the bases beside it are others, so that it is no longer than that."""
    d = backgrounds.withColumn("probe", F.explode(F.array(*map(F.lit, lengths)))).where(F.length("strand") >= F.col("probe") + 2)
    number = F.floor(uniform(F.col("strand_id"), F.col("probe"), "letter") * 4).cast("int")
    letter = lambda shift: F.substring(F.lit(BASES), ((number + shift) % 4 + 1).cast("int"), F.lit(1))
    at = _place(F.length("strand") - F.col("probe") - 1, F.col("probe"), "run") + 1
    before, after = (F.substring("strand", i, F.lit(1)) for i in (at - 1, at + F.col("probe")))
    beside = lambda there, shift: F.when(there == letter(0), letter(shift)).otherwise(there)
    whole = F.concat(beside(before, 1), F.repeat(letter(0), F.col("probe")), beside(after, 2))
    return d.select("strand_id", "probe", _written(at - 1, whole).alias("strand"))


def gc_designs(backgrounds: DataFrame, shares: list[float], longest: int = 3) -> DataFrame:
    """(strand_id, probe, strand): for each share of G and C a strand as long as every background, letter by letter by keyed draws; those with a longer run than longest are left out."""
    def base(i: Column) -> Column:
        u, v = uniform(F.col("strand_id"), F.col("probe"), i, "gc"), uniform(F.col("strand_id"), F.col("probe"), i, "base")
        return F.when(u < F.col("probe"), F.when(v < 0.5, "G").otherwise("C")).otherwise(F.when(v < 0.5, "A").otherwise("T"))

    d = backgrounds.where(F.length("strand") > 0).withColumn("probe", F.explode(F.array(*map(F.lit, shares))))
    d = d.select("strand_id", "probe", F.array_join(F.transform(F.sequence(F.lit(1), F.length("strand")), base), "").alias("strand"))
    return d.where(max_run_length(F.col("strand")) <= longest)


def effects(designs: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(probe, n, mean) of designs, all scored by one call; score takes rows with a strand and returns them with a column score."""
    return score(designs).groupBy("probe").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
