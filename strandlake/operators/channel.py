"""A seeded sequencing channel: every draw is a pure function of its keys, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.strands import BASES, dropout_probability, gc_fraction, uniform


def coverage(strand_id: Column, mean: float, seed: int) -> Column:
    """Reads of a strand: a geometric number with the given mean (a negative binomial of shape 1), by its inverse."""
    p = 1 / (1 + mean)
    return F.floor(F.log1p(-uniform(strand_id, "reads", seed)) / F.log(F.lit(1 - p))).cast("int")


def reads_of(strands: DataFrame, mean: float, seed: int, dropout: float = 0.0, gc_factor: float = 0.0) -> DataFrame:
    """strands (strand_id, strand) with one row for each read (read_no); a strand that is lost or has no read has no row."""
    lost = uniform(F.col("strand_id"), "lost", seed) < dropout_probability(gc_fraction(F.col("strand")), F.lit(dropout), F.lit(gc_factor))
    n = strands.withColumn("n_reads", F.when(lost, 0).otherwise(coverage(F.col("strand_id"), mean, seed)))
    return n.where("n_reads > 0").withColumn("read_no", F.explode(F.sequence(F.lit(1), "n_reads"))).drop("n_reads")


def mutate(reads: DataFrame, sub: float, ins: float, dele: float, seed: int) -> DataFrame:
    """reads (strand_id, read_no, strand) with the read that the channel makes of the strand.

    One number in each position decides between deletion, insertion before the base, substitution by one of the three other bases, and none. Rows
    stay rows: the positions are an array, not a shuffle.
    """
    def piece(i: Column) -> Column:
        b = F.substring("strand", i, F.lit(1))
        u = uniform(F.col("strand_id"), F.col("read_no"), i, seed)
        v = uniform(F.col("strand_id"), F.col("read_no"), i, "base", seed)
        other = F.substring(F.lit(BASES), ((F.instr(F.lit(BASES), b) - 1 + 1 + F.floor(v * 3)) % 4 + 1).cast("int"), F.lit(1))
        new = F.substring(F.lit(BASES), (F.floor(v * 4) + 1).cast("int"), F.lit(1))
        return F.when(u < dele, "").when(u < dele + ins, F.concat(new, b)).when(u < dele + ins + sub, other).otherwise(b)

    return reads.withColumn("read", F.array_join(F.transform(F.sequence(F.lit(1), F.length("strand")), piece), ""))


def edits(reads: DataFrame, sub: float, ins: float, dele: float, seed: int) -> DataFrame:
    """(strand_id, read_no, tag, src_pos, dest_pos, letter) of what the channel does to the strand of each of reads (strand_id, read_no, strand); a quarter of the insertions are of two letters."""
    u, v = (uniform(F.col("strand_id"), F.col("read_no"), F.col("i"), *more, seed) for more in ((), ("base",)))
    sites = reads.select("strand_id", "read_no", "strand", F.explode(F.sequence(F.lit(1), F.length("strand"))).alias("i")).withColumn("u", u).where(F.col("u") < sub + ins + dele).withColumn("v", v)
    base = lambda x: F.substring(F.lit(BASES), (F.floor(x * 4) + 1).cast("int"), F.lit(1))
    other = F.substring(F.lit(BASES), ((F.instr(F.lit(BASES), F.substring("strand", F.col("i"), F.lit(1))) + F.floor(F.col("v") * 3)) % 4 + 1).cast("int"), F.lit(1))
    edit = lambda tag, more, letter: F.struct(F.lit(tag).alias("tag"), (F.col("i") - 1 + more).alias("dest_pos"), letter.alias("letter"))
    first, second = edit("insert", 0, base(F.col("v"))), edit("insert", 1, base(F.col("v") * 4))
    made = F.when(F.col("u") < dele, F.array(edit("delete", 0, F.lit(None).cast("string")))).when(F.col("u") >= dele + ins, F.array(edit("replace", 0, other))).when(F.col("v") < 0.25, F.array(first, second)).otherwise(F.array(first))
    return sites.select("strand_id", "read_no", (F.col("i") - 1).alias("src_pos"), F.explode(made).alias("e")).select("strand_id", "read_no", "e.tag", "src_pos", "e.dest_pos", "e.letter")


def misassigned(reads: DataFrame, strands: DataFrame, rate: float, seed: int) -> DataFrame:
    """reads with the strand that each is read from: for a share of them another strand of the same key space (0 to n - 1)."""
    n = strands.agg(F.count("*").alias("n"))
    wrong = uniform(F.col("strand_id"), F.col("read_no"), "wrong", seed) < rate
    shift = 1 + F.floor(uniform(F.col("strand_id"), F.col("read_no"), "shift", seed) * (F.col("n") - 1))
    source = F.when(wrong, (F.col("strand_id") + shift) % F.col("n")).otherwise(F.col("strand_id"))
    r = reads.select("strand_id", "read_no").crossJoin(F.broadcast(n)).withColumn("source_id", source).drop("n")  # n is one row
    return r.join(strands.select(F.col("strand_id").alias("source_id"), "strand"), "source_id")


def first_reads(reads: DataFrame, k: int, seed: int) -> DataFrame:
    """k reads of each strand without replacement, chosen by a hash and in their own order."""
    w = Window.partitionBy("strand_id").orderBy(uniform(F.col("strand_id"), F.col("read_no"), "pick", seed), "read_no")
    return reads.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")
